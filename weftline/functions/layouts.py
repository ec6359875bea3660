"""Layouts of token streams as text, and back: tags with an id, bounds, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.rotations import _let
from weftline.functions.tokens import hash_number, interleave


def tag(kind: str, token: Column | int) -> Column:
    """`<kind_id_7>`."""
    return F.lit(f"<{kind}_id_{token}>") if isinstance(token, int) else F.concat(F.lit(f"<{kind}_id_"), token.cast("string"), F.lit(">"))


def tags(kind: str, tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: tag(kind, t)), "")


def bounded(kind: str, tokens: Column, size: int, first: int = 0) -> Column:
    """All tags between those of the ids size + first and size + first + 1."""
    return F.concat(tag(kind, size + first), tags(kind, tokens), tag(kind, size + first + 1))


def stream_by_stream(streams: dict[str, Column], length: Column, outer: str = "motion") -> Column:
    """The first `length` tokens of one stream after the other, in one pair of bounds."""
    return F.concat(tag(outer, 0), *[tags(k, F.slice(c, 1, length)) for k, c in streams.items()], tag(outer, 1))


def step_by_step(streams: dict[str, Column], length: Column, outer: str = "motion") -> Column:
    """One token of each stream a step, for `length` steps, in one pair of bounds."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda i: i < length)
    steps = F.transform(at, lambda i: F.concat(*[tag(k, F.get(c, i)) for k, c in streams.items()]))
    return F.concat(tag(outer, 0), F.array_join(steps, ""), tag(outer, 1))


def with_transcript(audio: Column, texts: Column, size: int) -> Column:
    """Each audio tag followed by the text of its time; bounds are size + 3 and size + 4."""
    both = F.zip_with(audio, F.slice(texts, 1, F.size(audio)), lambda a, t: F.concat(tag("audio", a), F.coalesce(t, F.lit(""))))
    return F.concat(tag("audio", size + 3), F.array_join(both, ""), tag("audio", size + 4))


def spaced(tokens: Column, name: str = "atoken") -> Column:
    """`[atoken1] [atoken2]`."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit(f"[{name}"), t.cast("string"), F.lit("]"))), " ")


def middle(text: Column, kind: str, size: int) -> Column:
    """The text between the first tags of the ids size and size + 1, with these bounds.

    A text without one of them gives a single token 0 in bounds.
    """
    start, stop = f"<{kind}_id_{size}>", f"<{kind}_id_{size + 1}>"
    i, j = F.instr(text, start), F.instr(text, stop)
    inner = F.substr(text, i + len(start), F.greatest(j - i - len(start), F.lit(0)))
    return F.when((i > 0) & (j > 0), F.concat(F.lit(start), inner, F.lit(stop))).otherwise(F.lit(f"{start}<{kind}_id_0>{stop}"))


def parse_middle(text: Column, kind: str, size: int) -> tuple[Column, Column]:
    """(tokens, text): the ids between the bounds, [0] if there are none, and the text
    with the bounded part replaced by a placeholder."""
    part = middle(text, kind, size)
    pieces = F.split(part, "><")
    ids = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda s: F.regexp_replace(F.element_at(F.split(s, "_"), -1), ">", "").try_cast("int"))
    ids = F.when(F.size(ids) == 0, F.array(F.lit(0))).otherwise(ids)
    return ids, F.replace(text, part, F.lit(f"<{kind.capitalize()}_Placeholder>"))


def parse_all(text: Column, modalities: list[str]) -> Column:
    """A map from each modality to its ids, in order, of tokens like `<|audio_1|>`."""
    ids = lambda m: F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"<\|{m}_(\d+)\|>"), 1), lambda s: s.try_cast("int")), lambda x: x.isNotNull())
    return F.create_map(*[x for m in modalities for x in (F.lit(m), ids(m))])


def mask_run(tokens: Column, share: float, mask: int, key: Column, seed: int = 42) -> Column:
    """A run of int(n * share) tokens masked, from a place that a hash of the key chooses."""
    n = F.size(tokens)
    m = F.floor(n * share).cast("int")
    start = F.pmod(hash_number(key, seed), n - m + 1)
    return F.transform(tokens, lambda t, i: F.when((i >= start) & (i < start + m), mask).otherwise(t))


def split_head(tokens: Column, share: float) -> tuple[Column, Column]:
    """The first int(n * share + 1) tokens, and the rest."""
    head = F.floor(F.size(tokens) * share + 1).cast("int")
    return F.slice(tokens, 1, head), F.slice(tokens, head + 1, F.size(tokens) + 1)


def noise_mask(length: Column, density: float, mean_span: float, key: Column, seed: int = 42) -> Column:
    """Which of `length` places are noise, in spans of random lengths; the first isn't.

    The lengths of noise and other spans cut their totals at places that a hashed
    order chooses, so the numbers of noise places and spans are fixed.
    """
    noise = F.least(F.greatest(F.bround(length * density).cast("int"), F.lit(1)), length - 1)
    spans = F.greatest(F.bround(noise / mean_span).cast("int"), F.lit(1))

    def cuts(items: Column, salt: int) -> Column:
        """Ends of the spans: spans - 1 of the places 1 .. items - 1, and items."""
        places = F.filter(F.sequence(F.lit(1), F.greatest(items - 1, F.lit(1))), lambda p: p < items)
        order = F.array_sort(F.transform(places, lambda p: F.struct(F.md5(F.concat(key.cast("string"), F.lit(f":{seed + salt}:"), p.cast("string"))).alias("h"), p.alias("p"))))
        return F.concat(F.array_sort(F.transform(F.slice(order, 1, spans - 1), lambda x: x["p"])), F.array(items))

    other_ends, noise_ends = cuts(length - noise, 1), cuts(noise, 2)
    # span k of noise starts after k + 1 other spans and k of noise
    starts = F.zip_with(other_ends, F.concat(F.array(F.lit(0)), noise_ends), lambda a, b: a + b)
    stops = F.zip_with(other_ends, noise_ends, lambda a, b: a + b)
    bounds = F.filter(F.arrays_zip(starts.alias("s"), stops.alias("e")), lambda x: x["s"].isNotNull() & x["e"].isNotNull())
    # the spans one after the other: what is before each, and itself
    run = lambda value, n: F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))
    end = lambda b, i: F.coalesce(F.get(b, i - 1)["e"], F.lit(0))
    spread = lambda b: F.concat(F.flatten(F.transform(b, lambda x, i: F.concat(run(False, x["s"] - end(b, i)), run(True, x["e"] - x["s"])))), run(False, length - F.coalesce(F.element_at(b, -1)["e"], F.lit(0))))
    return F.slice(_let(bounds, spread), 1, F.greatest(length, F.lit(0)))


def sentinels(mask: Column, first: int) -> Column:
    """Per place: first - k at the start of the k-th run of noise, -1 in the rest of it, 0 outside."""
    at = lambda m, i: F.coalesce(F.get(m, i), F.lit(False))
    # the first places of runs in order, then the places behind them, run by run
    begins = lambda m: F.filter(F.transform(m, lambda x, i: F.when(x & ~at(m, i - 1), i)), lambda i: i.isNotNull())
    ends = lambda m: F.filter(F.transform(m, lambda x, i: F.when(x & ~at(m, i + 1), i + 1)), lambda i: i.isNotNull())
    run = lambda value, n: F.array_repeat(F.lit(value), n.cast("int"))
    pieces = lambda b, e, n: F.concat(F.flatten(F.transform(b, lambda s, k: F.concat(run(0, s - F.coalesce(F.get(e, k - 1), F.lit(0))), F.array(first - k - 1), run(-1, F.get(e, k) - s - 1)))), run(0, n - F.coalesce(F.element_at(e, -1), F.lit(0))))
    return _let(mask, lambda m: _let(begins(m), lambda b: _let(ends(m), lambda e: F.when(F.size(b) > 0, pieces(b, e, F.size(m))).otherwise(run(0, F.size(m))))))


def model_record(audio: Column, face: Column | None, length: int, offset: int = 1024, bos: int = 1, eos: int = 2, upsample: int = 1) -> Column:
    """A struct of input_ids, attention_mask, position_ids and token_type_ids.

    Face tokens repeat `upsample` times and interleave with audio ones; two places
    are kept for bos and eos. Without face tokens (inference), half of the length
    holds audio tokens, bounds not counted.
    """
    if face is None:
        ids = F.slice(audio, 1, length // 2)
    else:
        ids = F.slice(interleave(audio, F.flatten(F.transform(face, lambda t: F.array_repeat(t, upsample))), offset), 1, length - 2)
    ids = F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda t: F.lit(1)).alias("attention_mask"), F.transform(ids, lambda t, i: i).alias("position_ids"), F.transform(ids, lambda t: F.lit(0)).alias("token_type_ids"))


def split_modalities(tokens: Column, kinds: Column, names: list[str]) -> Column:
    """A map from each modality to its (token, position) pairs, in order."""
    pairs = F.zip_with(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("position"))), kinds, lambda p, k: F.struct(p["token"].alias("token"), p["position"].alias("position"), k.alias("kind")))
    own = lambda n: F.transform(F.filter(pairs, lambda p: p["kind"] == n), lambda p: F.struct(p["position"].alias("position"), p["token"].alias("token")))
    return F.create_map(*[x for n in names for x in (F.lit(n), own(n))])


def restore_order(parts: Column) -> Column:
    """The sequence that split_modalities took apart."""
    return F.transform(F.array_sort(F.flatten(F.map_values(parts))), lambda p: p["token"])
