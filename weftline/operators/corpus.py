"""Corpus assembly: splits, caps, vocabularies, keyed joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.words import CLASSES, LEXICON, one_hot
from weftline.operators.shared import stored

# The special words of a vocabulary, before the first real id.
SPECIALS = {"<pad>": 0, "<sos>": 1, "<eos>": 2, "<unk>": 3}
#: Words of a vocabulary that is broadcast.
BROADCAST_WORDS = 500_000


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def random_split(rows: DataFrame, key: str, seed: int = 42, shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Rows with `split`: train, val or test by place in a hashed order of the key.

    The hash is cut into buckets that are counted first, so no task ranks all
    rows: a row's place is its rank in its bucket plus the rows of the ones before.
    """
    x = rows.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = x.groupBy("_b").agg(F.count("*").alias("_m"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    offsets = counts.select("_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"), F.sum("_m").over(Window.partitionBy()).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h")) - 1 + F.col("_o")
    a, b = F.floor(F.col("_n") * shares[0]), F.floor(F.col("_n") * (shares[0] + shares[1]))
    out = x.join(F.broadcast(offsets), "_b").withColumn("_p", place)
    return out.withColumn("split", F.when(F.col("_p") < a, "train").when(F.col("_p") < b, "val").otherwise("test")).drop("_h", "_b", "_o", "_n", "_p", "_m")


def range_number(rows: DataFrame, key: Column, parts: int = 64) -> Column:
    """The number of a range of a numeric key, in its order and of about equal sizes.

    The bounds are literals, so every evaluation puts a row into the same range.
    """
    bounds = rows.agg(F.percentile_approx(key.cast("double"), [i / parts for i in range(1, parts)], F.lit(1000))).first()[0] or []
    inner = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]).cast("array<double>")
    return F.size(F.filter(inner, lambda b: b < key.cast("double")))


def ranked(rows: DataFrame, number: Column, order: list[str], name: str) -> DataFrame:
    """Rows with their place from 0 in an order, of which `number` names the ranges.

    Ranges are counted first; each is ranked by itself.
    """
    x = rows.withColumn("_p", number)
    counts = x.groupBy("_p").agg(F.count("*").alias("_m"))  # one row a range
    offsets = counts.select("_p", F.coalesce(F.sum("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.col("_o") + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return x.join(F.broadcast(offsets), "_p").select(*rows.columns, place.alias(name))


def fraction_cap(rows: DataFrame, group: str, key: str, rate: float, parts: int = 64) -> DataFrame:
    """The first round(n * rate) rows of each group, in the order of a numeric key, nulls last.

    A group is cut into ranges of its key that are counted first, so that no task
    ranks a whole group.
    """
    number = F.col(key).cast("double")
    bounds = rows.groupBy(F.col(group).alias("_g")).agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], F.lit(10_000)).alias("_bounds"), F.count("*").alias("_n"))
    # stored: percentiles depend on the order in which tasks are merged, and the counts and the ranks must have the same ranges
    bounds = stored(bounds)
    inner = F.array_distinct(F.coalesce("_bounds", F.array().cast("array<double>")))
    x = rows.join(bounds, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_p", F.when(number.isNull(), parts).otherwise(F.size(F.filter(inner, lambda b: b < number))))
    counts = x.groupBy("_g", "_p").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_g").alias("_h"), F.col("_p").alias("_q"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_p").orderBy(F.col(key).asc_nulls_last())))
    out = x.join(offsets, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q")))
    return out.where(F.col("_o") + F.col("_k") <= F.bround(F.col("_n") * rate)).select(*rows.columns)


def split_rule(rows: DataFrame, rules: DataFrame, split: str, speakers: list[int], additional: bool = False) -> DataFrame:
    """Rows whose id a rule puts in the split and whose speaker number is listed."""
    speaker = F.element_at(F.split("id", "_"), 1).try_cast("int")
    keep = rules.where((F.col("type") == split) & speaker.isin(speakers))
    if additional:
        keep = keep.unionByName(rules.where(F.col("type") == "additional"))
    return rows.join(keep.select("id").distinct(), "id", "left_semi")


def tokens_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word) of all words."""
    from weftline.functions.tokens import words

    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))


def vocabulary(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, n, id): words with at least `least` uses, ids in first-seen order.

    `words` has doc_id (a whole number), pos and word, or also n (uses of an entry).
    A word's place is one number, doc_id * 2^31 + pos, so counting combines in each
    task by hash. Ids are ranked in ranges of that place.
    """
    n = F.sum("n") if "n" in words.columns else F.count("*")
    place = F.col("doc_id").cast("decimal(28,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    # stored: the bounds of the ranges, their sizes and the ids all read it
    seen = stored(words.groupBy("word").agg(n.alias("n"), F.min(place.cast("decimal(38,0)")).alias("place")).where(F.col("n") >= least))
    out = ranked(seen, range_number(seen, F.col("place")), ["place"], "id")
    return out.select("word", "n", (F.col("id") + len(SPECIALS)).alias("id"))


def merge_vocabularies(first: DataFrame, other: DataFrame) -> DataFrame:
    """The words of both; each word of the other counts once and comes after."""
    a = first.select(F.lit(0).alias("doc_id"), F.col("id").alias("pos"), "word", "n")
    b = other.select(F.lit(1), F.col("id"), "word", F.lit(1))
    return vocabulary(a.union(b))


def encode_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words with their ids; unknown ones get that of <unk>.

    A vocabulary of at most BROADCAST_WORDS words goes to every task, so no word is
    shuffled; a larger one is joined.
    """
    known = vocab.select("word", "id")
    small = known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return words.join(F.broadcast(known) if small else known, "word", "left").withColumn("id", F.coalesce("id", F.lit(SPECIALS["<unk>"])))


def word_classes(words: DataFrame, known: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """Rows (word, tag, ...) with `word_class` and its one-hot vector `class_vec`.

    A class of the lexicon (word, class; the domain's own by default) goes before the tag, a
    tag that is no class and a word that `known` (word) lacks are OTHER. Of several classes of
    a word the first in the order of CLASSES counts. Lists of up to BROADCAST_WORDS words go
    to every task, larger ones are joined.
    """
    if lexicon is None:
        rows = [(w, c) for c, ws in LEXICON.items() for w in ws]
        lexicon = words.sparkSession.createDataFrame(rows, "word string, class string")
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("class"))
    first = lexicon.withColumn("_r", rank).where("_r > 0").groupBy("word").agg(F.min_by("class", "_r").alias("_own"))
    small = lambda x: F.broadcast(x) if x.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else x
    x = words.join(small(first), "word", "left")
    if known is not None:
        x = x.join(small(known.select("word").distinct().withColumn("_known", F.lit(True))), "word", "left")
    else:
        x = x.withColumn("_known", F.lit(True))
    tagged = F.when(F.col("tag").isin(CLASSES), F.col("tag")).otherwise("OTHER")
    name = F.when(F.col("_known"), F.coalesce("_own", tagged)).otherwise("OTHER")
    return x.withColumn("word_class", name).withColumn("class_vec", one_hot(F.col("word_class"))).drop("_own", "_known")


def with_reasons(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows with `reason`: the first rule (name, condition) that rejects them, or `kept`."""
    reason = F.lit("kept")
    for name, rejects in reversed(rules):
        reason = F.when(F.coalesce(rejects, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def rejections(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(reason, n): how many rows each rule rejects first."""
    return with_reasons(rows, rules).groupBy("reason").agg(F.count("*").alias("n"))


def stored_or_computed(rows: DataFrame, stored_: DataFrame, keys: list[str], column: str, computed: Column) -> DataFrame:
    """Rows with a column from a table of results that are there already, computed for the others."""
    have = stored_.select(*keys, F.col(column).alias("_stored"))
    return rows.withColumn("_own", computed).join(have, keys, "left").withColumn(column, F.coalesce("_stored", "_own")).drop("_stored", "_own")


class Derived:
    """Fields that are made of others only when they are asked for.

    A field has a name, the names that it needs, and an expression; `select` puts what the
    wanted ones need, directly or not, into the plan, and nothing else.
    """

    def __init__(self) -> None:
        self.made: dict[str, tuple[tuple[str, ...], Column]] = {}

    def field(self, name: str, needs: tuple[str, ...], value: Column) -> Derived:
        self.made[name] = (needs, value)
        return self

    def order(self, wanted: list[str], have: list[str]) -> list[str]:
        """The fields to make, each behind those that it needs; a circle is an error."""
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"{name} needs itself: {' from '.join((*above, name))}")
            if name in have or name in out:
                return
            if name not in self.made:
                raise KeyError(f"no field {name}")
            for need in self.made[name][0]:
                visit(need, (*above, name))
            out.append(name)

        for name in wanted:
            visit(name, ())
        return out

    def select(self, rows: DataFrame, *wanted: str) -> DataFrame:
        x = rows
        for name in self.order(list(wanted), rows.columns):
            x = x.withColumn(name, self.made[name][1])
        return x.select(*wanted)


def id_piece(name: Column, k: int, suffix: str = "") -> Column:
    """The k-th piece of an id between underscores, without its suffix."""
    bare = F.regexp_replace(name, "\\Q" + suffix + "\\E$", "") if suffix else name
    return F.get(F.split(bare, "_"), k)


def color_key(name: Column) -> Column:
    """A colour for a name: the first six digits of its MD5."""
    return F.concat(F.lit("#"), F.substring(F.md5(name), 1, 6))


def with_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every row with every task, however many there are."""
    return rows.crossJoin(tasks)


def pick_variant(key: Column, variants: Column, seed: int = 42) -> Column:
    """One element of an array, the same for a key in every run."""
    n = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long")
    return F.try_element_at(variants, (F.pmod(n, F.greatest(F.size(variants), F.lit(1))) + 1).cast("int"))


def with_mirrors(rows: DataFrame, prefix: str = "M_") -> DataFrame:
    """Originals that have a mirrored row (id with a prefix), both as samples."""
    plain, mirror = rows.where(~F.col("id").startswith(prefix)), rows.where(F.col("id").startswith(prefix))
    key = F.substring("id", len(prefix) + 1, 1 << 20)
    pairs = mirror.withColumn("_of", key)
    both = plain.join(pairs.select(F.col("_of").alias("id")), "id", "left_semi").withColumn("mirrored", F.lit(False))
    back = pairs.join(plain.select(F.col("id").alias("_of")), "_of", "left_semi").drop("_of").withColumn("mirrored", F.lit(True))
    return both.unionByName(back)


def complete_only(rows: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key every other modality has too."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), others, rows)


def union_datasets(*parts: DataFrame) -> DataFrame:
    """Bag union by column names; later rows of an id replace earlier ones."""
    tagged = [p.withColumn("_order", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    last = Window.partitionBy("id").orderBy(F.desc("_order"))
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_order")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet, for idempotent resumes."""
    return rows.join(done.select(key), key, "left_anti")


# The upper ends of the recording numbers of an emotion, from 1 on; the
# label is the place in this list. Only recordings of even types are labelled.
EMOTION_ENDS = [64, 72, 80, 86, 94, 102, 110, 118]
# Speakers whose numbers are moved before all are lowered by one.
SPEAKER_MOVES = {30: 8, 28: 14, 27: 19}


def emotion_label(number: Column, kind: Column | None = None) -> Column:
    """0 to 7 by the range of a recording's number; 0 for odd kinds, null beyond the ranges."""
    label = F.when((number < 1) | (number > EMOTION_ENDS[-1]), F.lit(None).cast("int"))
    for i, end in enumerate(EMOTION_ENDS):
        label = label.when(number <= end, i)
    return label if kind is None else F.when(kind.isin(0, 2, 4, 6), label).otherwise(0)


def speaker_number(number: Column) -> Column:
    """Speaker numbers without gaps, from 0."""
    moved = number
    for old, new in SPEAKER_MOVES.items():
        moved = F.when(number == old, new).otherwise(moved)
    return moved - 1
