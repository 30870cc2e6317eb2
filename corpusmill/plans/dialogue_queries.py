"""Queries over conversations and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scalar
from corpusmill.operators import answers, corpus, mixture, packing
from corpusmill.plans.corpus_queries import table
from corpusmill.plans.registry import query
from corpusmill.sources import sinks, text


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.turns_by_conversation(table(spark, sf_dir, "conversations"))


_CONV = "c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id)"


@query(f"WITH {_CONV} SELECT conv_id, CAST(len(texts) AS BIGINT) AS turns, roles[1] AS opener FROM c WHERE len(texts) >= 2")
def usable_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).filter(answers.usable(F.array("texts")))
    return rows.select("conv_id", F.size("texts").cast("bigint").alias("turns"), F.col("roles")[0].alias("opener"))


@query(f"""WITH {_CONV}, p AS (SELECT conv_id, unnest(range(1, len(texts))) AS k, roles, texts FROM c)
    SELECT conv_id, k, md5(texts[k] || '|' || texts[k + 1]) AS pair FROM p WHERE roles[k] = 'user' AND roles[k + 1] = 'assistant'""")
def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", "roles", "texts", F.posexplode("texts").alias("i", "q"))
    after = F.get("texts", F.col("i") + 1)
    rows = rows.filter((F.get("roles", "i") == "user") & (F.get("roles", F.col("i") + 1) == "assistant"))
    return rows.select("conv_id", (F.col("i") + 1).cast("bigint").alias("k"), F.md5(F.concat_ws("|", "q", after)).alias("pair"))


@query(f"""WITH {_CONV}, a AS (SELECT conv_id, unnest(range(1, len(texts) // 2 + 1)) AS k, texts FROM c)
    SELECT conv_id, k, CAST(strlen(texts[2 * k]) + 2 AS BIGINT) AS n, round(1.0 / sqrt(strlen(texts[2 * k]) + 2) / sqrt(3), 9) AS weight FROM a""")
def answer_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss weight of the tokens of each answer (byte tokens of a blank and the text, and the end)."""
    rows = conversations(spark, sf_dir).withColumn("k", F.explode(F.when(F.size("texts") > 1, F.sequence(F.lit(1).cast("bigint"), F.floor(F.size("texts") / 2)))))
    n = (F.octet_length(F.get("texts", 2 * F.col("k").cast("int") - 1)) + 2).cast("bigint")
    return rows.select("conv_id", "k", n.alias("n"), F.round(scalar.loss_weight(F.lit(1.0), n, F.lit(3)), 9).alias("weight"))


@query("""WITH x AS (SELECT conv_id, turn, text, ['alpha', 'beta', 'gamma', text] AS choices, CASE conv_id % 6 WHEN 0 THEN 'b' WHEN 1 THEN ' C ' WHEN 2 THEN '0' WHEN 3 THEN 'Z' WHEN 4 THEN text ELSE '' END AS answer FROM conversations)
    SELECT conv_id, turn, md5(trim(text) || chr(10) || 'Options: ' || array_to_string(choices, '; ')) AS question,
           md5(CASE conv_id % 6 WHEN 0 THEN 'beta' WHEN 1 THEN 'gamma' WHEN 2 THEN 'alpha' WHEN 3 THEN 'Z' ELSE trim(answer) END) AS answer
    FROM x WHERE conv_id % 6 <> 5""")
def choice_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by letter, by number and as text, resolved against the choices; an empty answer leaves its row out."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.col("conv_id") % 6
    answer = F.when(kind == 0, "b").when(kind == 1, " C ").when(kind == 2, "0").when(kind == 3, "Z").when(kind == 4, F.col("text")).otherwise("")
    rows = rows.select("conv_id", "turn", F.col("text").alias("question"), F.lit(None).cast("string").alias("query"), F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"), F.col("text")).alias("choices"), answer.alias("answer"), F.lit(None).cast("string").alias("label"))
    return answers.generic_pairs(rows).select("conv_id", "turn", F.md5("q").alias("question"), F.md5("a").alias("answer"))


@query(f"""WITH {_CONV}, z AS (SELECT conv_id, texts, unnest(range(1, len(texts) // 2 + 1)) AS i FROM c), v AS (SELECT conv_id, i, trim(texts[2 * i - 1]) AS q, trim(texts[2 * i]) AS a FROM z),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM v WHERE q <> '' AND a <> '')
    SELECT conv_id, CAST(k - 1 AS INTEGER) AS pair, md5(q) AS q, md5(a) AS a FROM n WHERE k <= 4""")
def listed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs kept as two lists: odd turns and even turns."""
    half = (F.size("texts") / 2).cast("int")
    pick = lambda shift: F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.get("texts", i * 2 + shift)))
    rows = conversations(spark, sf_dir).select("conv_id", F.struct(pick(0).alias("question"), pick(1).alias("answer")).alias("qa_pairs"))
    return answers.paired_lists(rows).select("conv_id", "pair", F.md5("q").alias("q"), F.md5("a").alias("a"))


@query("""WITH f AS (SELECT 'src' || CAST(conv_id % 7 AS VARCHAR) AS source, CASE WHEN conv_id % 3 = 0 THEN 'validation' ELSE 'test' END AS split FROM conversations WHERE conv_id % 7 < 5),
    s AS (SELECT 'src' || CAST(doc_id % 7 AS VARCHAR) AS source, 'test' AS split FROM documents WHERE doc_id % 7 > 2),
    a AS (SELECT source, split, count(*) AS n_full FROM f GROUP BY ALL), b AS (SELECT source, split, count(*) AS n_simple FROM s GROUP BY ALL)
    SELECT coalesce(a.source, b.source) AS source, coalesce(a.split, b.split) AS split, coalesce(n_full, 0) AS n_full, coalesce(n_simple, 0) AS n_simple FROM a FULL JOIN b ON a.source = b.source AND a.split = b.split""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, docs = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    name = lambda c: F.concat(F.lit("src"), (F.col(c) % 7).cast("string")).alias("source")
    full = conv.select(name("conv_id"), F.when(F.col("conv_id") % 3 == 0, "validation").otherwise("test").alias("split")).filter(F.col("source").isin("src0", "src1", "src2", "src3", "src4"))
    simple = docs.select(name("doc_id"), F.lit("test").alias("split")).filter(F.col("source").isin("src3", "src4", "src5", "src6"))
    return answers.source_split_counts(full, simple)


@query("""WITH f AS (SELECT DISTINCT 'src' || CAST(conv_id % 7 AS VARCHAR) AS source, CASE conv_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN 'train' ELSE CASE WHEN conv_id % 7 = 3 THEN 'validation' ELSE 'train' END END AS split FROM conversations),
    p AS (SELECT source, split, CASE split WHEN 'validation' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 END AS p FROM f WHERE split <> 'train')
    SELECT source, arg_min(split, p) AS split FROM p GROUP BY source""")
def preferred_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    kind = F.col("conv_id") % 4
    split = F.when(kind == 0, "test").when(kind == 1, "val").when(kind == 2, "train").otherwise(F.when(F.col("conv_id") % 7 == 3, "validation").otherwise("train"))
    return answers.first_split(conv.select(F.concat(F.lit("src"), (F.col("conv_id") % 7).cast("string")).alias("source"), split.alias("split")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def without_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def with_good_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("""WITH s AS (SELECT source AS name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) > 45 AS done FROM documents GROUP BY source)
    SELECT name, n FROM s WHERE NOT (done AND tokens >= least(110000, 100000))""")
def unfinished_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("tokens"))
    manifest = pools.select("name", "tokens", (F.col("n") > 45).alias("done"), F.lit(100_000).alias("target"))
    return corpus.not_done(pools.select("name", "n"), manifest, 110_000)


@query("""WITH o AS (SELECT source AS name, count(*) AS docs FROM documents GROUP BY source), n AS (SELECT source AS name, count(*) AS docs FROM documents WHERE lang = 'en' AND source < 'src2' GROUP BY source)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM n)""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    count = lambda d: d.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("docs"))
    return sinks.upsert(count(docs.filter((F.col("lang") == "en") & (F.col("source") < "src2"))), count(docs), "name")


@query("""SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 0""")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"))


@query("""SELECT source AS name FROM documents UNION SELECT lang FROM documents UNION SELECT role FROM conversations""")
def name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("name")).union(docs.select("lang")).union(table(spark, sf_dir, "conversations").select("role")).distinct()


@query("""WITH f AS (SELECT 'mix/' || source || '__' || lang || '.jsonl' AS path FROM documents) SELECT path, split_part(regexp_extract(path, '([^/]+)\\.jsonl$', 1), '__', 1) AS source, split_part(regexp_extract(path, '([^/]+)\\.jsonl$', 1), '__', 2) AS split, count(*) AS n FROM f GROUP BY path""")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.format_string("mix/%s__%s.jsonl", "source", "lang").alias("path"))
    source, split = text.source_of_file(F.col("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", source.alias("source"), split.alias("split"), "n")


@query("""WITH s AS (SELECT lang AS grp, CASE lang WHEN 'en' THEN 0.6 ELSE 0.2 END AS w, source, CAST(count(*) AS DOUBLE) AS size FROM documents GROUP BY ALL),
    r AS (SELECT grp, source, sqrt(greatest(size, 1.0)) / sum(sqrt(greatest(size, 1.0))) OVER (PARTITION BY grp) * w AS r FROM s)
    SELECT grp, source, round(r / sum(r) OVER (), 9) AS rate FROM r""")
def mixture_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("grp"), "source").agg(F.count(F.lit(1)).cast("double").alias("size"))
    rated = mixture.rates(sizes.withColumn("grp_weight", F.when(F.col("grp") == "en", 0.6).otherwise(0.2)))
    return rated.select("grp", "source", F.round("rate", 9).alias("rate"))


@query("""WITH w AS (SELECT source AS pool, CAST(sum(n_chars) AS DOUBLE) AS w FROM documents GROUP BY source), p AS (SELECT DISTINCT source AS pool FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
    k AS (SELECT * FROM w WHERE pool IN (SELECT pool FROM p))
    SELECT pool, round(w / sum(w) OVER (), 9) AS rate, round(sum(w) OVER () / (SELECT sum(w) FROM w), 9) AS coverage FROM k""")
def coverage_renormalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = docs.groupBy(F.col("source").alias("pool")).agg(F.sum("n_chars").cast("double").alias("w"))
    present = docs.select("doc_id", F.col("source").alias("pool")).join(table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id").select("pool")
    return mixture.renormalise(weights, present, "pool").select("pool", F.round("rate", 9).alias("rate"), F.round("coverage", 9).alias("coverage"))


@query("""WITH w AS (SELECT lang AS run_id, source AS pool, CAST(count(*) AS DOUBLE) AS w FROM documents GROUP BY ALL), p AS (SELECT DISTINCT source AS pool FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    c AS (SELECT run_id, coalesce(sum(CASE WHEN pool IN (SELECT pool FROM p) THEN w END) / sum(w), 0) AS coverage FROM w GROUP BY run_id)
    SELECT run_id, round(coverage, 9) AS coverage FROM c WHERE coverage >= 0.5""")
def runs_with_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = docs.groupBy(F.col("lang").alias("run_id"), F.col("source").alias("pool")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    present = docs.select("doc_id", F.col("source").alias("pool")).join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("pool")
    return mixture.coverage_by_run(weights, present, 0.5).select("run_id", F.round("coverage", 9).alias("coverage"))


@query("""WITH w AS (SELECT lang AS run_id, source AS grp, CAST(sum(n_chars) AS DOUBLE) AS w FROM documents GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w DESC, grp DESC) AS rank FROM w WHERE w > 0) SELECT run_id, CAST(rank AS INTEGER) AS rank, grp, w FROM r WHERE rank <= 3""")
def top_three_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("run_id"), F.col("source").alias("grp")).agg(F.sum("n_chars").cast("double").alias("w"))
    return mixture.top_groups(weights).select("run_id", "rank", "grp", "w")


@query("""WITH r AS (SELECT source AS run_id, CAST(avg(n_chars) AS DOUBLE) AS loss FROM documents GROUP BY source) SELECT run_id, round(loss, 6) AS loss FROM r ORDER BY loss, run_id LIMIT 8""")
def top_eight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_id")).agg(F.avg("n_chars").alias("loss"))
    return mixture.top_runs(results, "loss", 8).select("run_id", F.round("loss", 6).alias("loss"))


_RATES = "s AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source), r AS (SELECT source, n / sum(n) OVER () AS rate FROM s), c AS (SELECT source, coalesce(sum(rate) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(rate) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM r)"


@query(f"""WITH {_RATES}, u AS (SELECT event_id AS step, CAST('0x' || substr(md5('13|' || CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM events)
    SELECT step, source FROM u JOIN c ON u.u >= c.low AND u.u < c.high""")
def weighted_source_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each event, drawn by the sources' rates."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    rated = sizes.join(F.broadcast(total)).select("source", (F.col("n") / F.col("all")).alias("rate"))  # one row
    return mixture.weighted_draws(table(spark, sf_dir, "events").select(F.col("event_id").alias("step")), rated, "source", 13)


@query(f"""WITH {_RATES}, u AS (SELECT event_id AS step, CAST('0x' || substr(md5('13|' || CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM events),
    dr AS (SELECT step, source FROM u JOIN c ON u.u >= c.low AND u.u < c.high), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY step) - 1 AS k FROM dr),
    n AS (SELECT k.step, k.source, k.k // CAST(s.n AS BIGINT) AS e, k.k % CAST(s.n AS BIGINT) AS i FROM k JOIN s ON k.source = s.source),
    es AS (SELECT DISTINCT source, e FROM n), p AS (SELECT d.source, es.e, d.doc_id, row_number() OVER (PARTITION BY d.source, es.e ORDER BY md5('17|' || CAST(es.e AS VARCHAR) || '|' || CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1 AS i FROM documents d JOIN es ON d.source = es.source)
    SELECT n.step, n.source, p.doc_id FROM n JOIN p ON n.source = p.source AND n.e = p.e AND n.i = p.i""")
def epoch_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example that each draw takes from its source's current permutation."""
    return mixture.epochs(table(spark, sf_dir, "documents").select("doc_id", "source"), weighted_source_draws(spark, sf_dir), "source", "doc_id", 17)


@query(f"""WITH {_CONV}, p AS (SELECT conv_id, texts, unnest(range(1, len(texts) // 2 + 1)) AS k FROM c),
    l AS (SELECT conv_id, k, strlen(texts[2 * k - 1]) + 18 AS u, strlen(texts[2 * k]) + 2 AS a FROM p),
    e AS (SELECT *, sum(u + a) OVER (PARTITION BY conv_id ORDER BY k) AS stop FROM l),
    w AS (SELECT conv_id, sum(u + a) AS total, sum(greatest(0, least(stop, 1024) - (stop - a)) / sqrt(a)) AS weight, sum(CASE WHEN stop <= 1024 THEN 1 ELSE 0 END) AS ends FROM e GROUP BY conv_id)
    SELECT c.conv_id AS id, CAST(greatest(least(coalesce(total, 0), 1024) - 1, 0) AS BIGINT) AS n, CAST(coalesce(ends, 0) AS BIGINT) AS ends, round(coalesce(weight, 0), 6) AS weight FROM c LEFT JOIN w ON c.conv_id = w.conv_id""")
def encoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat-encoded conversations, byte tokens: positions, answers that end within the sequence, and the sum of weights."""
    rows = conversations(spark, sf_dir).select(F.col("conv_id").alias("id"), F.col("texts").alias("turns"), F.lit(1.0).alias("message_weight"), F.lit(1).alias("n_sub"))
    encode = lambda texts: [list(t.encode()) for t in texts]
    out = packing.encode_turns(rows, encode, 1024)
    ends = F.size(F.filter("targets", lambda t: t == corpus.START_ID))
    return out.select("id", F.size("inputs").cast("bigint").alias("n"), ends.cast("bigint").alias("ends"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


@query("""WITH RECURSIVE t AS (SELECT CAST(conv_id % 4 AS INTEGER) AS part, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id * 1000 + turn) AS i, text, role FROM conversations),
    z AS (SELECT part, i, j, text || ' ' || w || ' ' || role AS whole FROM t, (VALUES (0, 'one'), (1, 'two'), (2, 'three'), (3, 'four')) v(j, w)),
    need AS (SELECT part, i, CAST(sum(strlen(whole)) AS BIGINT) AS n FROM z GROUP BY part, i),
    g AS (SELECT part, i, 0 AS sequence, true AS opens, n - 1 AS upto FROM need WHERE i = 1
        UNION ALL SELECT part, need.i, sequence + CASE WHEN upto + n >= 16384 THEN 1 ELSE 0 END, upto + n >= 16384, CASE WHEN upto + n >= 16384 THEN n - 1 ELSE upto + n END FROM g JOIN need USING (part) WHERE need.i = g.i + 1),
    b AS (SELECT part, sequence, i, j, list_transform(range(strlen(whole) - 1), lambda k: CAST('0x' || substr(hex(encode(whole)), 2 * k + 1, 2) AS INTEGER)) AS bytes, opens AND j = 0 AS first FROM z JOIN g USING (part, i)),
    s AS (SELECT part, sequence, count(*) AS spans, flatten(list(CASE WHEN first THEN bytes ELSE list_prepend(50256, bytes) END ORDER BY i, j)) AS tokens FROM b GROUP BY part, sequence)
    SELECT part, sequence, CAST(spans // 4 AS INTEGER) AS tasks, md5(array_to_string(list_resize(tokens, 16384, 0), ',')) AS tokens_md5, CAST(spans AS INTEGER) AS spans FROM s""")
def packed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice tasks made from conversations, packed into sequences."""
    conv = table(spark, sf_dir, "conversations")
    endings = F.array(*(F.concat(F.lit(f"{w} "), "role") for w in ("one", "two", "three", "four")))
    task = F.col("conv_id") * 1000 + F.col("turn")
    tasks = conv.select((F.col("conv_id") % 4).cast("int").alias("part"), task.alias("task_id"), F.col("text").alias("ctx"), endings.alias("endings"), (F.col("turn") % 4).cast("int").alias("label"))
    packed = packing.pack_choices(tasks, lambda t: list(t.encode()), 16_384)
    return packed.select("part", "sequence", F.size("task_ids").alias("tasks"), F.md5(F.array_join("tokens", ",")).alias("tokens_md5"), F.size("spans").alias("spans"))
