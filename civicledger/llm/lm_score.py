"""Likelihood of whole texts under a lattice of words and subwords.

The lattice of a text has an arc for every word that the training documents hold, weighted by its count, and arcs for all ways to spell a
word in the pieces of an existing vocabulary. The vocabulary's own scores weight those pieces; where they are ranks of merges, a
piece of rank r weighs 1 / (r + 3). One pass of expectation and maximisation over the distinct training words fits these weights to
the corpus. A log-space forward recursion over a word's characters sums all spellings, and a word's probability sums both kinds of arcs:
(1 - new) * (share of the word) + new * (sum over spellings), `new` being the share of words seen once (Good-Turing). The share of a word
is mostly that in one of a few classes of documents (languages); the probability of the text is the marginal over the classes.

What is gathered from the corpus is a table of word counts, which grows with it and stays distributed. Each word's probability is
worked out once. The most frequent words, HOT at most, are sent to the tasks; all others are looked up by a join on the word.

Words are lower-cased (A-Z) and end at white space; every text has one end token more. Null and empty texts are one end token. A row trains
if crc32 of its id as text, modulo FOLDS, is not HELD_OUT; a row without an id counts as held out. A null class is a class of its own;
beyond CLASSES classes the rarer ones are one together. Without training rows every word is spelled. Repeated rows count each. Extra columns
are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from civicledger.session import stored

from .textarrays import LOWER, NOT_BLANK, ranges, slices, span_hashes, text_arrays, word_spans

FOLDS, HELD_OUT = 7, 2
HOT = 1 << 17
CLASSES = 8
#: part of a word's share that comes from all classes together
GENERAL = 0.02
#: pseudo-counts of the vocabulary's own weights, for each piece
PRIOR = 0.05
SLICE = 2 << 20
END = "\n"  # no word holds a line break, so the end token can stand for itself in the word table
_LOADED = {}


def vocabulary(path):
    """(number of each piece, log weights) of a sentencepiece vocabulary."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in own])
        usual = scores[scores > -1e8]
        if len(usual) and np.abs(usual - np.round(usual)).max() < 1e-6:  # ranks
            scores = -np.log(np.where(scores > -1e8, -scores, len(own)) + 3)
        _LOADED[path] = {model.id_to_piece(i): k for k, i in enumerate(own)}, scores - np.log(np.exp(scores).sum())
    return _LOADED[path]


class Lattice:
    """All spellings of words in the pieces; a character that is no piece is spelled in bytes."""

    def __init__(self, pieces, log_weights):
        self.pieces, self.weights = pieces, np.append(log_weights, -np.inf)
        self.longest = max(map(len, pieces), default=1)

    def _arcs(self, words):
        """(from, to, piece numbers, log weights) for words of one length, by start; a byte spelling has piece -1."""
        get, n = self.pieces.get, len(words[0])
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                number = np.array([get(w[i:j], -1) for w in words])
                weight = self.weights[number]
                if j == i + 1 and (number < 0).any():
                    spelled = np.array([math.log(1e-3) - len(w[i].encode("utf-8", "replace")) * math.log(256) for w in words])
                    weight = np.where(number < 0, spelled, weight)
                elif (number < 0).all():
                    continue
                yield i, j, number, weight

    def forward(self, words):
        """Log probability of each of the words (of one length), summed over all spellings."""
        a = np.full((len(words[0]) + 1, len(words)), -np.inf)
        a[0] = 0
        for i, j, _, weight in self._arcs(words):
            a[j] = np.logaddexp(a[j], a[i] + weight)
        return a[-1]

    def expected(self, words):
        """Expected number of uses of each piece over words of one length."""
        arcs, n = list(self._arcs(words)), len(words[0])
        a, b = np.full((n + 1, len(words)), -np.inf), np.full((n + 1, len(words)), -np.inf)
        a[0] = b[n] = 0
        for i, j, _, weight in arcs:
            a[j] = np.logaddexp(a[j], a[i] + weight)
        for i, j, _, weight in reversed(arcs):
            b[i] = np.logaddexp(b[i], b[j] + weight)
        out = np.zeros(len(self.weights))
        for i, j, number, weight in arcs:
            np.add.at(out, number, np.exp(a[i] + weight + b[j] - a[n]))
        return out[:-1]


def by_length(words, most=4096):
    """Numbers of the words in batches of one length; few characters a batch."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, min(most, 65536 // max(1, len(words[group[0]])))) if len(group) else 1
        for at in range(0, len(group), step):
            yield group[at : at + step]


def spans_column(data, starts, ends):
    """Spans of bytes as an Arrow string column."""
    sizes = ends - starts
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data[ranges(starts, sizes)])).cast(pa.string())


def distinct_words(data, starts, ends, first):
    """Distinct (text, word): number of the text, span of the word, count."""
    h = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, owner))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    return owner[order][at], starts[order][at], ends[order][at], counts


def _trains(key):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT, F.lit(False))


def classes_of(docs, column):
    """The CLASSES - 1 most frequent values (null as the empty string); all others are the last class."""
    if column is None:
        return []
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [r["v"] for r in docs.groupBy(value.alias("v")).count().orderBy(F.desc("count"), "v").limit(CLASSES - 1).collect()]


def word_counts(docs, names, id_column="doc_id", text="text", column="lang"):
    """(word, c0, c1, ...): how often each class's training texts hold each word of any text; END counts texts."""
    k = len(names) + 1
    number = F.lit(k - 1) if column is None else F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("int") - 1, F.lit(k - 1))
    number = F.when(number < 0, k - 1).otherwise(number) if names else F.lit(k - 1)
    rows = docs.select(text, number.alias("class"), _trains(id_column).alias("trains"))

    def count(batches):
        for part in slices(batches, text, SLICE):
            data, offsets = text_arrays(part.column(0))
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, NOT_BLANK)
            group = np.where(part.column(2).to_numpy(zero_copy_only=False), part.column(1).to_numpy(), k)
            owner = np.repeat(group, np.diff(first))
            for g in range(k + 1):
                own = np.flatnonzero(owner == g)
                if len(own):
                    _, s, e, n = distinct_words(data, starts[own], ends[own], np.array([0, len(own)]))
                    yield pa.record_batch([spans_column(data, s, e), pa.array(np.full(len(s), g, np.int32)), pa.array(n if g < k else np.zeros(len(n), np.int64))], names=["word", "class", "n"])
            n = np.bincount(group, minlength=k + 1)[:k]
            yield pa.record_batch([pa.array([END] * k), pa.array(np.arange(k, dtype=np.int32)), pa.array(n)], names=["word", "class", "n"])

    counts = rows.mapInArrow(count, "word string, class int, n bigint")
    return counts.groupBy("word").agg(*[F.sum(F.when(F.col("class") == g, F.col("n")).otherwise(0)).alias(f"c{g}") for g in range(k)]).withColumn("c", sum(F.col(f"c{g}") for g in range(k)))


def fitted(words, path):
    """Log weights of the pieces after one pass over the distinct training words."""
    pieces, start = vocabulary(path)

    def expect(batches):
        lattice, total = Lattice(*vocabulary(path)), np.zeros(len(pieces))
        for batch in batches:
            own = ["▁" + w for w in batch.column(0).to_pylist()]
            for group in by_length(own):
                total += lattice.expected([own[i] for i in group])
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    rows = words.where((F.col("c") > 0) & (F.col("word") != END)).select("word").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    uses = PRIOR * len(start) * np.exp(start)
    for r in rows:  # a row a piece at most
        uses[r["piece"]] += r["n"]
    return np.log(uses / uses.sum())


def word_scores(words, path, totals, k):
    """words with base (log10 of the add-one estimate) and l0, l1, ... (log10 of the model's probability in each class)."""
    spark = words.sparkSession
    weights = spark.sparkContext.broadcast(fitted(words, path))
    n, v, once, n_class = totals
    new = 1.0 if not n else min(0.5, max(once, 1) / n)

    def score(batches):
        lattice = Lattice(vocabulary(path)[0], weights.value)
        for batch in batches:
            own = ["▁" + w for w in batch.column(0).to_pylist()]
            spelled = np.empty(len(own))
            for group in by_length(own):
                spelled[group] = lattice.forward([own[i] for i in group])
            c = [batch.column(1 + g).to_numpy().astype(np.float64) for g in range(k)]
            total = sum(c)
            out = []
            for g in range(k):
                share = GENERAL * total / max(n, 1) + (1 - GENERAL) * (c[g] / n_class[g] if n_class[g] else total / max(n, 1))
                with np.errstate(divide="ignore"):
                    out.append(np.logaddexp(math.log(new) + spelled, np.log((1 - new) * share)) / math.log(10))
            yield pa.record_batch([batch.column(0), batch.column(1 + k), pa.array(np.log10((total + 1) / (n + v + 1))), *map(pa.array, out)], names=["word", "c", "base", *(f"l{g}" for g in range(k))])

    return words.select("word", *(f"c{g}" for g in range(k)), "c").mapInArrow(score, "word string, c bigint, base double, " + ", ".join(f"l{g} double" for g in range(k)))


def scores(docs, path, id_column="doc_id", text="text", column="lang"):
    """One row per row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    names = classes_of(docs, column)
    k = len(names) + 1
    words = stored(word_counts(docs, names, id_column, text, column), "word-counts")
    t = words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum((F.col("c") == 1).cast("long")), *[F.sum(f"c{g}") for g in range(k)]).first()
    n, v, once, *n_class = [int(x or 0) for x in t]
    ends = words.where(F.col("word") == END).first()
    trained = [ends[f"c{g}"] for g in range(k)] if ends else [0] * k
    scored = stored(word_scores(words, path, (n, v, once, n_class), k), "word-scores")
    values = ["known", "base", *(f"l{g}" for g in range(k))]
    hot = spark.sparkContext.broadcast(_hot(scored, k))
    prior = [math.log10((x + 1) / (sum(trained) + k)) for x in trained]

    def part_scores(batches):
        table, known = hot.value
        context, at = TaskContext.get(), 0
        at = (context.partitionId() if context else 0) << 36
        end = table[int(known[END.encode()])] if END.encode() in known else np.zeros(2 + k)
        hashes, place, numbers = known["hashes"], known["place"], table
        for part in slices(batches, text, SLICE):
            data, offsets = text_arrays(part.column(1))
            data = LOWER[data]
            starts, ends_, first = word_spans(data, offsets, NOT_BLANK)
            owner, s, e, tf = distinct_words(data, starts, ends_, first)
            h = span_hashes(data, s, e)
            where = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            is_hot = hashes[where] == h if len(hashes) else np.zeros(len(h), dtype=bool)
            rows = len(offsets) - 1
            sums = np.repeat(end[None, :], rows, axis=0)
            for c in range(2 + k):
                sums[:, c] += np.bincount(owner[is_hot], weights=tf[is_hot] * numbers[place[where[is_hot]], c], minlength=rows)
            rest = ~is_hot
            bounds = pa.array(np.searchsorted(owner[rest], np.arange(rows + 1)), pa.int32())
            yield pa.record_batch(
                [pa.array(np.arange(at, at + rows)), part.column(0), part.column(2), pa.array(np.diff(first) + 1), *(pa.array(np.ascontiguousarray(sums[:, c])) for c in range(2 + k)),
                 pa.ListArray.from_arrays(bounds, spans_column(data, s[rest], e[rest])), pa.ListArray.from_arrays(bounds, pa.array(tf[rest].astype(np.int32)))],
                names=["row", id_column, "held_out", "n_tokens", *values, "words", "tfs"])
            at += rows

    schema = f"row bigint, `{id_column}` {kind}, held_out boolean, n_tokens bigint, " + ", ".join(f"{x} double" for x in values) + ", words array<string>, tfs array<int>"
    parts = stored(docs.select(id_column, text, (~_trains(id_column)).alias("held_out")).mapInArrow(part_scores, schema), "hot-scores")
    asked = parts.select("row", F.explode(F.arrays_zip("words", "tfs")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.tfs").alias("tf"))
    rest = asked.join(scored, "word").select("row", (F.col("tf") * (F.col("c") > 0).cast("int")).cast("double").alias("known"), *[(F.col("tf") * F.col(x)).alias(x) for x in values[1:]])
    rest = rest.groupBy("row").agg(*[F.sum(x).alias(f"r_{x}") for x in values])
    both = parts.drop("words", "tfs").join(rest, "row", "left").withColumns({x: F.col(x) + F.coalesce(F.col(f"r_{x}"), F.lit(0.0)) for x in values})
    # a class that no training document has plays no part, unless there are none at all
    live = [g for g in range(k) if trained[g] or not sum(trained)]
    each = [F.col(f"l{g}") + F.lit(prior[g]) for g in live]
    top = F.greatest(*each) if len(each) > 1 else each[0]
    marginal = top + F.log10(sum(F.pow(F.lit(10.0), x - top) for x in each))
    return both.select(id_column, "held_out", "n_tokens", F.round("known").cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), marginal.alias("score"))


def _hot(scored, k):
    """The values of the most frequent words, HOT at most, and of END, for the tasks: (table, places by hash).

    The least count that is sent comes from a histogram of sixteenths of powers of two, so no more rows than that leave a task.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in scored.where("c > 0").groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > HOT:
            break
        least = at
    rows = scored.where((F.col("c") > 0) & (step >= F.lit(least if least is not None else 1 << 20))).toPandas()
    end = scored.where(F.col("word") == END).toPandas()
    table = np.concatenate([f[["c", "base", *(f"l{g}" for g in range(k))]].to_numpy(dtype=np.float64).reshape(-1, 2 + k) for f in (rows, end)])
    table[:, 0] = table[:, 0] > 0
    words = [w.encode() for w in rows["word"]]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes)
    h = span_hashes(data, ends - sizes, ends) if len(words) else np.zeros(0, np.uint64)
    order = np.argsort(h)
    known = {"hashes": h[order], "place": order}
    if len(end):
        known[END.encode()] = len(words)
    return table, known
