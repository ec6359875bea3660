"""Corpus queries: splits, caps, vocabularies, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import corpus as C
from weftline.operators import kinematics as K
from weftline.plans._tables import FRAMES, frames, r6, table


def deterministic_split(spark, sf_dir):
    return C.random_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def fraction_cap(spark, sf_dir):
    return C.fraction_cap(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.3)


def split_rule(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat((F.col("doc_id") % 12).cast("string"), F.lit("_"), "source", F.lit("_"), F.col("doc_id").cast("string")).alias("id"))
    rules = d.select("id", F.when(F.col("doc_id") % 5 == 0, "val").when(F.col("doc_id") % 17 == 0, "additional").otherwise("train").alias("type"))
    return C.split_rule(d, rules, "train", [1, 3, 5], additional=True)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def vocab_build(spark, sf_dir):
    return C.vocabulary(C.tokens_of(_docs(spark, sf_dir)))


def vocab_trim(spark, sf_dir):
    return C.vocabulary(C.tokens_of(_docs(spark, sf_dir)), 5)


def vocab_merge(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return C.merge_vocabularies(C.vocabulary(C.tokens_of(d.where("lang = 'en'"))), C.vocabulary(C.tokens_of(d.where("lang = 'de'"))))


def oov_encode(spark, sf_dir):
    t = C.tokens_of(_docs(spark, sf_dir))
    coded = C.encode_words(t, C.vocabulary(t, 20))
    return coded.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("id") == 3).cast("int")).alias("unknown"), F.sum(F.col("id") * (F.col("pos") + 1)).alias("checksum"))


def cross_tasks(spark, sf_dir):
    tasks = spark.createDataFrame([("a2t", "audio to text"), ("t2a", "text to audio"), ("a2f", "audio to face")], "task string, prompt string")
    return C.with_tasks(table(spark, sf_dir, "conversations").select("conv_id", "turn"), tasks)


def variant_pick(spark, sf_dir):
    v = F.array(*[F.lit(x) for x in ("one", "two", "three", "four", "five")])
    return table(spark, sf_dir, "documents").select("doc_id", C.pick_variant(F.col("doc_id"), v).alias("variant"))


def mirrored_union(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    plain = e.select(F.col("vec_id").cast("string").alias("id"), "label")
    mirror = e.where("vec_id % 3 = 0").select(F.concat(F.lit("M_"), F.col("vec_id").cast("string")).alias("id"), "label")
    return C.with_mirrors(plain.union(mirror))


def semi_missing(spark, sf_dir):
    """Documents that have labels and a benchmark entry under the same number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return C.complete_only(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels"), b)


def anti_done(spark, sf_dir):
    return C.not_done(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def union_last_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return C.union_datasets(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"))


def left_default(spark, sf_dir):
    d, lb = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(lb, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def utterance_join(spark, sf_dir):
    """Texts and tokens of utterances on a composite key; missing texts drop out."""
    e = table(spark, sf_dir, "events")
    key = ["user_id", "event_type", "part"]
    tokens = e.select("user_id", "event_type", (F.col("event_id") % 7).alias("part"), "event_id").groupBy(*key).agg(F.count("*").alias("n_tokens"))
    texts = e.where("value > 30").select("user_id", "event_type", (F.col("event_id") % 7).alias("part"), "value").groupBy(*key).agg(F.max("value").alias("top"))
    return tokens.join(texts, key)


def rejection_counts(spark, sf_dir):
    rules = [("too short", F.col("n_chars") < 200), ("too long", F.col("n_chars") > 8000), ("language", F.col("lang") != "en")]
    return C.rejections(table(spark, sf_dir, "documents"), rules)


def stored_contacts(spark, sf_dir):
    """Contacts of frames: those that are stored already, others from the frames."""
    f = frames(spark, sf_dir).select("seq_id", "frame", "value", "event_id")
    done = f.where("event_id % 3 = 0").select("seq_id", "frame", (F.col("event_id") % 2 + 10).cast("int").alias("contact"))
    return C.stored_or_computed(f, done, ["seq_id", "frame"], "contact", K.contact("value", 0.5)).select("seq_id", "frame", "contact")


def derived_fields(spark, sf_dir):
    """Of four fields only those that the wanted one needs are made."""
    fields = C.Derived().field("words", ("n_chars",), F.col("n_chars") / 6).field("pages", ("words",), F.ceil(F.col("words") / 250)).field("sheets", ("pages",), F.ceil(F.col("pages") / 2)).field("unused", ("nothing",), F.col("nothing"))
    return fields.select(table(spark, sf_dir, "documents"), "doc_id", "sheets", "pages")


def id_pieces(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", F.col("doc_id") % 7, F.concat("source", F.lit(".npz"))).alias("id"))
    return d.select("doc_id", *[C.id_piece(F.col("id"), k, ".npz").alias(f"piece{k}") for k in range(4)])


def range_labels(spark, sf_dir):
    """Emotion labels by a recording's kind and number, and speakers without gaps."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 121).alias("number"), (F.col("doc_id") % 8).alias("kind"), (F.col("doc_id") % 30 + 1).alias("speaker"))
    return d.select("doc_id", C.emotion_label(F.col("number")).alias("emotion"), C.emotion_label(F.col("number"), F.col("kind")).alias("by_kind"), C.speaker_number(F.col("speaker")).alias("speaker"))


def top_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rank", rank).where("rank <= 5").select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


def two_level_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    per = li.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m"))
    return per.join(o, per.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(r6(F.avg("m")).alias("mean_of_means"), F.count("*").alias("n_orders"))


def color_keys(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select("source", C.color_key(F.col("source")).alias("color"), F.element_at(F.split("source", "c"), -1).alias("number"))


QUERIES = {f.__name__: f for f in (deterministic_split, fraction_cap, split_rule, vocab_build, vocab_trim, vocab_merge, oov_encode, cross_tasks, variant_pick, mirrored_union, semi_missing, anti_done, union_last_wins, left_default, utterance_join, rejection_counts, range_labels, top_orders, two_level_means, color_keys, stored_contacts, derived_fields, id_pieces)}
_WORDS = r"""w0 AS (SELECT doc_id, lang, list_filter(string_split_regex(translate(text, ',.?!', '    '), '[ \t\n\v\f\r]+'), lambda w: len(w) > 0) AS ws FROM documents),
w AS (SELECT doc_id, lang, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS word FROM w0)"""
_VOCAB = "SELECT word, n, row_number() OVER (ORDER BY first) + 3 AS id FROM (SELECT word, COUNT(*) AS n, MIN(struct_pack(d := doc_id, p := pos)) AS first FROM w {where} GROUP BY word HAVING COUNT(*) >= {least})"
ORACLE = {
    "stored_contacts": f"""WITH {FRAMES} SELECT seq_id, CAST(frame AS INTEGER) AS frame, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 2 + 10 AS INTEGER)
ELSE CAST(COALESCE(abs(lead(value) OVER (PARTITION BY seq_id ORDER BY frame) - value), 0) < 0.5 AS INTEGER) END AS contact FROM frames""",
    "derived_fields": "SELECT doc_id, CAST(ceil(ceil(n_chars / 6 / 250) / 2) AS BIGINT) AS sheets, CAST(ceil(n_chars / 6 / 250) AS BIGINT) AS pages FROM documents",
    "id_pieces": "SELECT doc_id, lang AS piece0, CAST(doc_id % 7 AS VARCHAR) AS piece1, source AS piece2, NULL AS piece3 FROM documents",
    "deterministic_split": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) - 1 AS p, COUNT(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p < floor(n * 0.8) THEN 'train' WHEN p < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM a""",
    "fraction_cap": """WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, COUNT(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM a WHERE k <= round_even(n * 0.3, 0)""",
    "split_rule": """SELECT (doc_id % 12) || '_' || source || '_' || doc_id AS id, doc_id FROM documents
WHERE doc_id % 5 <> 0 AND ((doc_id % 17 <> 0 AND doc_id % 12 IN (1, 3, 5)) OR doc_id % 17 = 0)""",
    "vocab_build": f"WITH {_WORDS} " + _VOCAB.format(where="", least=1),
    "vocab_trim": f"WITH {_WORDS} " + _VOCAB.format(where="", least=5),
    "vocab_merge": f"""WITH {_WORDS}, en AS ({_VOCAB.format(where="WHERE lang = 'en'", least=1)}), de AS ({_VOCAB.format(where="WHERE lang = 'de'", least=1)}),
u AS (SELECT 0 AS o, id, word, n FROM en UNION ALL SELECT 1, id, word, 1 FROM de), g AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n, MIN(struct_pack(o := o, i := id)) AS first FROM u GROUP BY word)
SELECT word, n, row_number() OVER (ORDER BY first) + 3 AS id FROM g""",
    "oov_encode": f"""WITH {_WORDS}, v AS ({_VOCAB.format(where="", least=20)}), x AS (SELECT w.doc_id, w.pos, COALESCE(v.id, 3) AS id FROM w LEFT JOIN v USING (word))
SELECT doc_id, COUNT(*) AS n, CAST(SUM(CASE WHEN id = 3 THEN 1 ELSE 0 END) AS BIGINT) AS unknown, CAST(SUM(id * (pos + 1)) AS BIGINT) AS checksum FROM x GROUP BY doc_id""",
    "cross_tasks": "SELECT conv_id, turn, task, prompt FROM conversations, (VALUES ('a2t', 'audio to text'), ('t2a', 'text to audio'), ('a2f', 'audio to face')) t(task, prompt)",
    "variant_pick": "SELECT doc_id, (['one', 'two', 'three', 'four', 'five'])[CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 5 + 1] AS variant FROM documents",
    "mirrored_union": "SELECT CAST(vec_id AS VARCHAR) AS id, label, FALSE AS mirrored FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 'M_' || vec_id, label, TRUE FROM embeddings WHERE vec_id % 3 = 0",
    "semi_missing": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT item_id FROM benchmark)",
    "anti_done": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "union_last_wins": "SELECT doc_id AS id, NULL AS lang, quality FROM labels UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "left_default": "SELECT d.doc_id, COALESCE(quality, 1) AS quality, COALESCE(toxic, 0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)",
    "utterance_join": """WITH a AS (SELECT user_id, event_type, event_id % 7 AS part, COUNT(*) AS n_tokens FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, event_id % 7 AS part, MAX(value) AS top FROM events WHERE value > 30 GROUP BY ALL)
SELECT * FROM a JOIN b USING (user_id, event_type, part)""",
    "rejection_counts": "SELECT CASE WHEN n_chars < 200 THEN 'too short' WHEN n_chars > 8000 THEN 'too long' WHEN lang <> 'en' THEN 'language' ELSE 'kept' END AS reason, COUNT(*) AS n FROM documents GROUP BY 1",
    "range_labels": """WITH a AS (SELECT doc_id, doc_id % 121 AS n, doc_id % 8 AS kind, doc_id % 30 + 1 AS speaker FROM documents),
b AS (SELECT *, CASE WHEN n >= 1 AND n <= 64 THEN 0 WHEN n >= 65 AND n <= 72 THEN 1 WHEN n >= 73 AND n <= 80 THEN 2 WHEN n >= 81 AND n <= 86 THEN 3 WHEN n >= 87 AND n <= 94 THEN 4
  WHEN n >= 95 AND n <= 102 THEN 5 WHEN n >= 103 AND n <= 110 THEN 6 WHEN n >= 111 AND n <= 118 THEN 7 END AS emotion FROM a)
SELECT doc_id, emotion, CASE WHEN kind IN (0, 2, 4, 6) THEN emotion ELSE 0 END AS by_kind, CASE speaker WHEN 30 THEN 8 WHEN 28 THEN 14 WHEN 27 THEN 19 ELSE speaker END - 1 AS speaker FROM b""",
    "top_orders": """WITH a AS (SELECT o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, o_orderkey, o_totalprice FROM orders) SELECT * FROM a WHERE rank <= 5""",
    "two_level_means": "WITH p AS (SELECT l_orderkey, AVG(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT o_orderpriority, round(AVG(m), 6) + 0.0 AS mean_of_means, COUNT(*) AS n_orders FROM p JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "color_keys": "SELECT DISTINCT source, '#' || substr(md5(source), 1, 6) AS color, string_split(source, 'c')[-1] AS number FROM documents",
}
