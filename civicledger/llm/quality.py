"""Quality rules whose cutoffs come with a guarantee.

Each text gets its counts (words, symbols, repeated lines, repeated 3-word windows) and from them a few ratios, the rules' values.
For each rule and stratum (language), labelled documents decide how strict a cutoff may be: of a fixed list of cutoffs, from the most
lenient on, a cutoff is accepted as long as an exact binomial test rejects "more than RISK / rules of the good documents fall to it";
the first that doesn't pass ends the list. Of the accepted cutoffs the one is taken that catches most of what the rules before left,
WORTH bad documents counting as much as one good document. Testing in a fixed order needs no correction within the list; the level is divided by the
number of rules and strata. With probability 1 - LEVEL all cutoffs together then reject at most RISK of any stratum's good documents.
Where labels are too few to prove anything, no document is rejected by the rule.

Base rules (fewer than 50 words, over half of the words in repeated 3-word windows) hold in any case. Null texts have no words. A null
language is a stratum of its own. A document labelled more than once is good if any label says so; labels without a document are
ignored. Empty tables give no rows, or rows judged by the base rules alone. Extra columns are ignored.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from civicledger.session import stored

from .textarrays import NOT_BLANK, mix, per_text_windows, slices, span_hashes, text_arrays, window_hashes, word_spans

RISK = 0.05
LEVEL = 0.05
#: bad documents that a cutoff must catch for each good one it rejects, to be preferred to a more lenient one
WORTH = 10
#: cutoffs of a rule; a document's bin is how many of them its value reaches
BINS = 64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(column):
    """The counts of each text, in the order of COUNTS, and the number of lines with a word."""
    data, offsets = text_arrays(column)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, NOT_BLANK)
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    chars = np.concatenate([[0], np.cumsum(characters[ends] - characters[starts])])
    words = np.diff(first)
    # lines: a line break belongs to none; lines without a word don't count
    blank = np.zeros(256, dtype=bool)
    blank[10] = True
    l_start, l_end, l_first = word_spans(data, offsets, ~blank)
    has = np.searchsorted(starts, l_start) < np.searchsorted(starts, l_end)
    l_start, l_end = l_start[has], l_end[has]
    l_owner = np.searchsorted(offsets[1:], l_start, "right")
    keyed = mix(span_hashes(data, l_start, l_end) + l_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(keyed, return_index=True)
    lines, distinct = np.bincount(l_owner, minlength=n), np.bincount(l_owner[kept], minlength=n)
    # words inside 3-word windows that the text holds twice
    at, owner = per_text_windows(first, 3)
    repeated = np.zeros(n, np.int64)
    if len(at):
        keyed = mix(window_hashes(span_hashes(data, starts, ends), 3)[at] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed, kind="stable")
        ranked = keyed[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        inside = np.zeros(len(starts), dtype=bool)
        for k in range(3):
            inside[at[twice] + k] = True
        total = np.concatenate([[0], np.cumsum(inside)])
        repeated = np.diff(total[first])
    return words, np.diff(chars[first]), np.diff(symbols[offsets]), lines - distinct, repeated, lines


def features(docs, id_column="doc_id", text="text", stratum="lang", carried=()):
    """One row per row of docs: its id, stratum, the carried columns, COUNTS and n_lines (lines with a word)."""
    rows = docs.select(id_column, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text, *carried)
    kind = docs.schema[id_column].dataType.simpleString()
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)

    def count(batches):
        for part in slices(batches, text):
            yield pa.record_batch([*part.columns[:2], *part.columns[3:], *(pa.array(c.astype(np.int64)) for c in text_counts(part.column(2)))], names=[id_column, "stratum", *carried, *COUNTS, "n_lines"])

    return rows.mapInArrow(count, f"`{id_column}` {kind}, stratum string, {kinds}" + ", ".join(f"{c} bigint" for c in [*COUNTS, "n_lines"]))


def rule_bins():
    """The rules: how many cutoffs a document's value reaches, 0 to BINS. Larger is worse."""
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    bins = {
        "symbols": F.col("n_symbols") / chars * (2 * BINS),  # half of all characters reach the last cutoff
        "repeats": F.col("n_repeat_words") / words * BINS,
        "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) * BINS,
        "long_words": F.col("word_chars") / words * 4 - 12,  # quarters of a character beyond 3 a word
        "short_words": F.lit(BINS) - F.col("word_chars") / words * 8,  # eighths of a character below 8 a word
    }
    return {k: F.least(F.greatest(F.floor(v).cast("int"), F.lit(0)), F.lit(BINS)) for k, v in bins.items()}


def binomial_tail(x, n, p):
    """P(at most x of n) at probability p."""
    if x >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(v - top) for v in logs))


def proven(good, new_good, new_bad, risk, level):
    """The best of the cutoffs that are proven harmless, None if none is of use.

    good[b] counts the labelled good documents of bin b, new_good and new_bad those that no rule before rejects.
    """
    n, best, most = int(sum(good)), None, 0
    fallen = gain = 0
    for cut in range(BINS, 0, -1):
        fallen, gain = fallen + int(good[cut]), gain + int(new_bad[cut]) - WORTH * int(new_good[cut])
        # the test is passed by few falls only: beyond the mean it can't be, and the sum stays short
        if not n or fallen > risk * n or binomial_tail(fallen, n, risk) > level:
            break
        if gain > most:
            best, most = cut, gain
    return best


def cutoffs(rows, labels, id_column="doc_id", good="quality", risk=RISK, level=LEVEL):
    """(stratum, a cutoff column for each rule) from labelled rows. Counts per stratum and bin are all that a rule gathers."""
    rules = rule_bins()
    said = labels.where(F.col(good).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(F.col(good).cast("int")).alias("is_good"))
    binned = rows.where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))).join(said, id_column)
    binned = stored(binned.select("stratum", (F.col("is_good") > 0).alias("is_good"), *[v.alias(k) for k, v in rules.items()]), "labelled-bins")
    chosen = binned.select("stratum").distinct()
    each_risk, each_level = risk / len(rules), level / (len(rules) * max(1, chosen.count()))

    def choose(key, part):
        by_bin = [np.bincount(part["bin"], weights=part[c], minlength=BINS + 1) for c in ("good", "new_good", "new_bad")]
        return pd.DataFrame({"stratum": [key[0]], "cutoff": pd.array([proven(*by_bin, each_risk, each_level)], dtype="Int32")})

    free, one = F.lit(True), F.lit(1).cast("bigint")
    for rule in rules:
        counts = (binned.join(chosen, "stratum").groupBy("stratum", F.col(rule).alias("bin"))
                  .agg(*[F.coalesce(F.sum(F.when(c, one)), F.lit(0)).alias(n) for n, c in (("good", F.col("is_good")), ("new_good", F.col("is_good") & free), ("new_bad", ~F.col("is_good") & free))]))
        cut = counts.groupBy("stratum").applyInPandas(choose, "stratum string, cutoff int").withColumnRenamed("cutoff", f"cut_{rule}")
        chosen = stored(chosen.join(cut, "stratum", "left"), f"cutoffs-{rule}")
        free = free & F.coalesce(F.col(rule) < F.col(f"cut_{rule}"), F.lit(True))
    return chosen


def judge(docs, labels, id_column="doc_id", text="text", stratum="lang", good="quality", risk=RISK, level=LEVEL, carried=()):
    """One row per row of docs: its id, stratum, the carried columns of docs, COUNTS, base_failed, rules that rejected it, kept."""
    rows = stored(features(docs, id_column, text, stratum, carried), "quality-features")
    cuts = cutoffs(rows, labels, id_column, good, risk, level)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = [F.when(v >= F.col(f"cut_{k}"), F.lit(k)) for k, v in rule_bins().items()]
    out = rows.join(cuts, "stratum", "left").withColumn("base_failed", failed).withColumn("rejected_by", F.array_compact(F.array(*named)))
    return out.select(id_column, "stratum", *carried, *COUNTS, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))
