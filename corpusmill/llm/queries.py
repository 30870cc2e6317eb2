"""The registered queries: each applies one operator to its whole table and derives
the columns of the result's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontam, importance, language_id, line_dedup, minhash, neighbours, packing, quality, secrets, store, substring_dedup, token_files, tokens, topk

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), out, tokens.public_path("byte_bpe_50k.json"), kind="byte", end_id=0)
    return token_files.digests(token_files.read(spark, out))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokens.public_path("word_bpe_49k.json"), kind="word", end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def fold(name: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(name).cast("string")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    models = language_id.fit(docs.filter("not held_out").select("text", "lang"))
    found = language_id.predict(docs, models)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Network:
    """Learns only from labels whose crc32(doc_id as text) mod 3 is not 1."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1).select("doc_id", "quality")
    return quality.fit(docs, labels)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality_network(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.DECISION).cast("int").alias("predicted"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate, with the forest's score; the value itself is left out, only its digest is given."""
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)))
    return found.select("doc_id", F.col("position").cast("long").alias("position"), "kind", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations by the contract's rule and repairs them; a conversation that has lost all its turns comes back empty."""
    turns = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(turns)).withColumnRenamed("conv_id", "_of")
    ids = turns.select("conv_id").distinct()
    zero = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    return joined.select("conv_id", *(F.coalesce(F.col(c), v).alias(c) for c, v in (zero | none).items()))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    found = (op1_packing, op2_substring_dedup, op3_token_files, op4_language_id, op5_line_dedup, op6_top_k, op7_quality, op8_near_dedup, op9_secrets, op10_decontamination, op11_conversation_repair, op12_nearest_neighbours, op13_importance_resampling)
    return {f.__name__: f for f in found}


#: DuckDB has no CRC-32: (x, crc) of the rows (x) of ``texts``, by a table of bytes that its rule makes.
_CRC = """byte_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(b AS BIGINT))) AS of_byte),
        hexed AS (SELECT x, hex(encode(x)) AS h FROM texts),
        crcs AS (SELECT x, xor(4294967295, list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                     lambda c, b: xor(of_byte[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS crc FROM hexed, byte_table)"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _edits(role: str, letter: str, extra: str) -> str:
    """SQL: price, audit and lines of the states of the accumulator ``a`` after a turn ``x`` stays with a role; ``extra`` is what an edit costs."""
    step = lambda state, inserts, lines: f"{{'c': a.{state}.c + {extra} + {5 * len(inserts)}, 't': a.{state}.t || '{inserts}' || {letter}, 'r': a.{state}.r || {lines} || chr(10) || {role} || ':' || x.text}}"
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    if role == "'user'":
        return ", ".join([*(step(s, "", "''") for s in "esa"), step("u", "I", assistant)])
    return ", ".join([step("u", "", "''"), *(step(s, "I", user) for s in "esa")])


def _stay(state: str, role: str, initial: str) -> str:
    kept = f"(CASE WHEN x.role[1] = '{initial}' THEN x.role ELSE {role} END)"
    letter = f"(CASE WHEN x.role[1] = '{initial}' THEN 'K' ELSE 'R' END)"
    extra = f"((CASE WHEN x.role[1] = '{initial}' THEN 0 ELSE 1 END) + x.cut)"
    options = _edits(role, letter, extra).replace(f"chr(10) || {role} || ':' || x.text", f"chr(10) || {kept} || ':' || x.text")
    gone = f"{{'c': a.{state}.c + 2, 't': a.{state}.t || 'D', 'r': a.{state}.r}}"
    return f"CASE WHEN x.gone THEN {gone} ELSE list_min([{gone}, {options}]) END"


_SYSTEM = "{'c': a.e.c + x.cut, 't': a.e.t || 'K', 'r': a.e.r || chr(10) || x.role || ':' || x.text}"
_NOTHING = "{'c': 1000000000000, 't': '', 'r': ''}"
_STEP = f"""{{'e': {{'c': a.e.c + 2, 't': a.e.t || 'D', 'r': a.e.r}},
                's': CASE WHEN x.gone OR x.role[1] <> 's' THEN {{'c': a.s.c + 2, 't': a.s.t || 'D', 'r': a.s.r}} ELSE list_min([{{'c': a.s.c + 2, 't': a.s.t || 'D', 'r': a.s.r}}, {_SYSTEM}]) END,
                'u': {_stay("u", "'user'", "u")},
                'a': {_stay("a", "'assistant'", "a")}}}"""

#: DuckDB SQL of the queries that it can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM p),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM g),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE least < doc_id),
        v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT v.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed,
                     string_agg(v.word, ' ' ORDER BY v.i) FILTER (gone.i IS NULL) AS kept
              FROM v LEFT JOIN gone ON v.doc_id = gone.doc_id AND v.i = gone.i GROUP BY v.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op5_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
        k AS (SELECT doc_id, i, line, regexp_replace(translate(line, {_UPPER}), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
        s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        x AS (SELECT k.doc_id, k.i, k.line, coalesce(s.last <> k.doc_id, false) AS gone FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM x GROUP BY doc_id""",
    "op6_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
        k AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM bw),
        sizes AS (SELECT DISTINCT n FROM k),
        dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
        m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, k.item_id FROM dw JOIN k ON k.n = dw.n AND k.k = array_to_string(list_slice(dw.w, dw.i, dw.i + dw.n - 1), ' ')),
        h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
               sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op11_conversation_repair": rf"""
        WITH named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
        texts AS (SELECT DISTINCT x FROM named), {_CRC},
        kinds AS (SELECT named.*, crc % 20 AS kind FROM named JOIN crcs USING (x)),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i FROM damaged),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS core, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        faults AS (SELECT *, CASE WHEN core = '' THEN 1 WHEN nth > 1 THEN 2 WHEN core[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM seen),
        convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                         count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, list({{'role': role, 'text': text, 'cut': CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'gone': fault IN (1, 2)}} ORDER BY i) AS turns FROM faults GROUP BY conv_id),
        solved AS (SELECT *, list_reduce(turns, lambda a, x: {_STEP}, {{'e': {{'c': CAST(0 AS BIGINT), 't': '', 'r': ''}}, 's': {_NOTHING}, 'u': {_NOTHING}, 'a': {_NOTHING}}}) AS a FROM convs),
        best AS (SELECT *, list_min([a.e, {{'c': a.s.c + 10, 't': a.s.t || 'II', 'r': a.s.r || chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': a.u.c + 5, 't': a.u.t || 'I', 'r': a.u.r || chr(10) || 'assistant:'}}, a.a]) AS b FROM solved)
        SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(b.r[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id""",
    "op13_importance_resampling": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w, row_number() OVER () AS n FROM documents),
        b AS (SELECT {_WORDS} AS w FROM benchmark),
        dw AS (SELECT n, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
        dc AS (SELECT n, x, count(*) AS c FROM dw GROUP BY ALL), bc AS (SELECT x, count(*) AS c FROM bw GROUP BY ALL),
        texts AS (SELECT x FROM dc UNION SELECT x FROM bc),
        {_CRC},
        buckets AS (SELECT x, crc % 10000 AS k FROM crcs),
        s AS (SELECT k, sum(c) AS s FROM dc JOIN buckets USING (x) GROUP BY k), t AS (SELECT k, sum(c) AS t FROM bc JOIN buckets USING (x) GROUP BY k),
        gains AS (SELECT r.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
                  FROM (SELECT unnest(range(10000)) AS k) r LEFT JOIN s ON s.k = r.k LEFT JOIN t ON t.k = r.k),
        weights AS (SELECT n, CAST(sum(c * gain) AS BIGINT) AS weight FROM dc JOIN buckets USING (x) JOIN gains USING (k) GROUP BY n),
        scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
                   FROM d LEFT JOIN weights USING (n)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features < 20 ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) OVER (PARTITION BY n_features < 20) AS eligible FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= eligible * 10 // 100 THEN r END AS rank FROM ranked""",
}
