"""The registered queries of the operators, over the whole tables below a folder."""

from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, decontaminate, html_extract, jaccard_join, line_dedup, lm_score, packing, prefix_trie, quality, suffix_dedup, token_counts, token_output


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark, folder):
    return jaccard_join.join(table(spark, folder, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op2_line_dedup(spark, folder):
    return line_dedup.dedup(table(spark, folder, "documents"), counted=True).select("doc_id", "n_lines", "n_dropped", "text")


def op3_token_output(spark, folder):
    files, book = token_output.write_token_files(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_output.read_token_files(files, book).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontamination(spark, folder):
    return decontaminate.digests(decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op5_packing(spark, folder):
    return packing.digests(packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")))


def op6_token_counts(spark, folder):
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_lm_score(spark, folder):
    return lm_score.scores(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_suffix_dedup(spark, folder):
    return suffix_dedup.repeats(table(spark, folder, "documents"))


def op9_quality_rules(spark, folder):
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("stratum").withColumn("rejected_by", F.array_join("rejected_by", ","))


def op10_html_extraction(spark, folder):
    return html_extract.extract(table(spark, folder, "pages"))


def op11_conversation_repair(spark, folder):
    edits = conversation_repair.repair(conversation_repair.damaged(table(spark, folder, "conversations")), present="present")
    return conversation_repair.reports(edits).withColumnRenamed("conv", "conv_id")


def op12_byte_bpe(spark, folder):
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN), path))


def op13_prefix_trie(spark, folder):
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, folder, "conversations"))).drop("key", "parent")


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_line_dedup, op3_token_output, op4_decontamination, op5_packing, op6_token_counts, op7_lm_score, op8_suffix_dedup, op9_quality_rules, op10_html_extraction, op11_conversation_repair, op12_byte_bpe, op13_prefix_trie)}
#: crc32 of an ASCII text, bit by bit
_CRC = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::bigint)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op1_jaccard_join": f"""
      WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) > 0)),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        linked AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        reach(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON l.a = r.o)
      SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op4_decontamination": f"""
      WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        patterns AS (SELECT DISTINCT item_id, p, len(p) AS m FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS p FROM b WHERE len(w) > 0)),
        windows AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m),
        found AS (SELECT doc_id, i, v.m, item_id FROM (SELECT doc_id, m, i, w[i:i + m - 1] AS p FROM windows) v JOIN patterns USING (p)),
        hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM found) GROUP BY 1)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # states 1 to 4: nothing yet, after a system turn, a user turn, an assistant turn; costs of the endings from the last row up, then the letters
    "op11_conversation_repair": f"""
      WITH RECURSIVE x AS (SELECT *, {_CRC.format("k")} % 20 AS kind FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) AS k FROM conversations)),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM x, range(2) AS copies(k2) WHERE kind <> 0 AND (k2 = 0 OR kind = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, E' \\t\\n\\x0b\\f\\r') AS body, left(role, 1) AS c FROM d),
        r AS MATERIALIZED (SELECT conv_id, turn, role, text, i, c, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        w AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more,
          [CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 END, CASE c WHEN 'u' THEN 3 END, CASE c WHEN 'a' THEN 4 END, CASE c WHEN 'u' THEN 3 END] AS kept FROM r),
        figures AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
        back(conv_id, i, b) AS (SELECT conv_id, n + 1, [0, 6, 3, 0] FROM figures UNION ALL
          SELECT conv_id, i, [least(v[1], 3 + v[3], 6 + v[4]), least(v[2], 3 + v[3], 6 + v[4]), least(v[3], 3 + v[4]), least(v[4], 3 + v[3])] FROM
            (SELECT w.conv_id, w.i, list_transform([1, 2, 3, 4], lambda q: least(4 + b[q], CASE WHEN NOT must THEN 3 + more + b[[3, 3, 4, 3][q]] END, CASE WHEN NOT must AND kept[q] IS NOT NULL THEN more + b[kept[q]] END)) AS v
             FROM back JOIN w ON w.conv_id IS NOT DISTINCT FROM back.conv_id AND w.i = back.i - 1)),
        walk(conv_id, i, q, audit, lines, cost) AS (SELECT conv_id, 1::bigint, 1, '', []::varchar[], 0 FROM figures UNION ALL
          SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept[q] ELSE [3, 3, 4, 3][q] END, audit || letter,
            CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, ['user', 'user', 'assistant', 'user'][q] || ':' || text) ELSE list_append(lines, ['user', 'user', 'assistant', 'user'][q] || ':') END,
            cost + CASE letter WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN more ELSE 3 + more END
          FROM (SELECT walk.*, w.role, w.text, w.more, w.kept, CASE WHEN w.i IS NULL THEN 'I' WHEN 4 + later.b[q] = now.b[q] THEN 'D' WHEN 3 + now.b[[3, 3, 4, 3][q]] = now.b[q] THEN 'I' WHEN kept[q] IS NOT NULL AND more + later.b[kept[q]] = now.b[q] THEN 'K' ELSE 'R' END AS letter
            FROM walk JOIN back AS now ON now.conv_id IS NOT DISTINCT FROM walk.conv_id AND now.i = walk.i LEFT JOIN back AS later ON later.conv_id IS NOT DISTINCT FROM walk.conv_id AND later.i = walk.i + 1
              LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM walk.conv_id AND w.i = walk.i WHERE w.i IS NOT NULL OR q IN (2, 3))),
        done AS (SELECT walk.* FROM walk JOIN figures ON figures.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE i = n + 1 AND q IN (1, 4))
      SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
      FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN figures ON figures.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_prefix_trie": f"""
      WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("name")} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::varchar AS name FROM t)),
        turns AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base WHERE p <= h UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE p > h),
        paths AS (SELECT c.conv_id, coalesce(any_value(path), []) AS path FROM c LEFT JOIN (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY own, p) AS path FROM turns GROUP BY 1) USING (conv_id) GROUP BY 1),
        members AS MATERIALIZED (SELECT conv_id, d, path[1:d] AS k, d = len(path) AS ended FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
        nodes AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(k[d].x), 0) AS saved, sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM members GROUP BY k, d),
        children AS MATERIALIZED (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        sums AS (SELECT k[1:up] AS k, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT nodes.k, saved, (children.n IS NULL)::bigint AS leaf, unnest(range(0, d + 1)) AS up FROM nodes LEFT JOIN children ON children.k = nodes.k) GROUP BY 1)
      SELECT v.conv_id, v.d AS depth, above.conv_id AS parent_conv_id, v.n_convs, coalesce(children.n, 0) AS n_children, leaves::bigint AS n_leaves, sums.saved::bigint AS saved_tokens, v.ends_sha256
      FROM nodes v JOIN sums ON sums.k = v.k LEFT JOIN children ON children.k = v.k LEFT JOIN nodes above ON v.d > 0 AND above.k = v.k[1:v.d - 1]""",
}
