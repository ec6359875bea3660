"""Column functions on token strings and token arrays.

All are built-in expressions, so they stay inside generated JVM code. Arrays are
0-based in the arguments (half-open ranges), as positions in a sequence are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of roles and speakers, and the pattern of a token.
ROLE_TAGS = {"user": "<|user|>", "assistant": "<|assistant|>", "system": "<|system|>"}
SPEAKER_TAGS = ("<|speaker_A|>", "<|speaker_B|>")
ROLE_PATTERN = r"<\|(?:user|assistant|system)\|>"
TOKEN = r"<\|{}_(\d+)\|>"


def render_tokens(tokens: Column, modality: str) -> Column:
    """`<|audio_1|><|audio_2|>` from an array of ids."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit(f"<|{modality}_"), t.cast("string"), F.lit("|>"))), "")


def render_interleaved(streams: list[tuple[str, Column]]) -> Column:
    """One token of each stream per step, as long as all have one."""
    n = F.least(*[F.size(c) for _, c in streams]) if len(streams) > 1 else F.size(streams[0][1])
    step = lambda i: F.concat(*[F.concat(F.lit(f"<|{m}_"), F.get(c, i).cast("string"), F.lit("|>")) for m, c in streams])
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), step), "")


def parse_tokens(text: Column, modality: str) -> Column:
    """Ids of one modality in order; too large ones are left out."""
    found = F.regexp_extract_all(text, F.lit(TOKEN.format(modality)), 1)
    return F.filter(F.transform(found, lambda s: s.try_cast("int")), lambda x: x.isNotNull())


def parse_single(text: Column) -> Column:
    """The id of a text that is one token, else null."""
    return F.nullif(F.regexp_extract(text, r"^<\|[a-z]+_(\d+)\|>$", 1), F.lit("")).try_cast("int")


def count_tokens(text: Column) -> Column:
    """Role tags, audio and face tokens, line breaks, and words that are no tags."""
    tags = F.regexp_count(text, F.lit(ROLE_PATTERN)) + F.regexp_count(text, F.lit(r"<\|(?:audio|face)_\d+\|>")) + F.regexp_count(text, F.lit("\n"))
    plain = lambda w: (F.length(w) > 0) & ~(w.startswith("<|") & w.endswith("|>")) & ~w.rlike(r"^<\|(?:audio|face)_")
    return (tags + F.size(F.filter(F.split(text, r"\s+"), plain))).cast("long")


def count_turn_tokens(text: Column) -> Column:
    """As count_tokens, without the words."""
    return (F.regexp_count(text, F.lit(ROLE_PATTERN)) + F.regexp_count(text, F.lit(r"<\|(?:audio|face)_\d+\|>")) + F.regexp_count(text, F.lit("\n"))).cast("long")


def speakers_to_roles(text: Column, key: Column, seed: int = 42) -> Column:
    """Speaker tags become roles; a hash of the key decides who is the user."""
    swap = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 4), 16, 10).cast("int") % 2 == 1
    change = lambda a, b: F.replace(F.replace(text, F.lit(a), F.lit("<|user|>\n")), F.lit(b), F.lit("<|assistant|>\n"))
    return F.when(swap, change(SPEAKER_TAGS[1], SPEAKER_TAGS[0])).otherwise(change(*SPEAKER_TAGS))


def split_turns(text: Column) -> Column:
    """Turns of a transcript, each from its user tag on; a blank head is dropped."""
    return F.filter(F.split(text, r"(?=<\|user\|>)"), lambda s: F.length(F.trim(s)) > 0)


def side(turn: Column, role: str) -> Column:
    """The user part of a turn (up to the assistant's), or the assistant part."""
    pattern = r"(?s)(<\|user\|>.*?)(?=<\|assistant\|>)" if role == "user" else r"(?s)(<\|assistant\|>.*)"
    return F.regexp_extract(turn, pattern, 1)


def both_sides_have(turn: Column, modality: str = "audio") -> Column:
    token = rf"<\|{modality}_\d+\|>"
    return side(turn, "user").rlike(token) & side(turn, "assistant").rlike(token)


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<\|[^|]*\|>", ""))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders replaced one after another, in the given order."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit(name), value)
    return out


def words(text: Column) -> Column:
    """Punctuation becomes space; words are what is left between spaces."""
    return F.filter(F.split(F.translate(text, ",.?!", "    "), r"\s+"), lambda w: F.length(w) > 0)


def interleave(a: Column, b: Column, offset: int) -> Column:
    """Alternating tokens, the second stream offset; the longer tail follows."""
    return F.filter(F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y + offset))), lambda v: v.isNotNull())


def concat(a: Column, b: Column, offset: int) -> Column:
    return F.concat(a, F.transform(b, lambda y: y + offset))


def fit(tokens: Column, length: int, pad: int = 0) -> Column:
    """Cut or padded to a length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), length)), 1, length)


def separate(tokens: Column, offset: int) -> tuple[Column, Column]:
    """Tokens below the offset, and those from it on with the offset taken off."""
    return F.filter(tokens, lambda t: t < offset), F.transform(F.filter(tokens, lambda t: t >= offset), lambda t: t - offset)


def upsample(tokens: Column, times: int) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.array_repeat(t, times)))


def resize_nearest(tokens: Column, length: Column) -> Column:
    """Nearest resampling: place i takes the token at floor(i * n / m)."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda i: i < length)
    return F.transform(at, lambda i: F.get(tokens, F.floor(i * F.size(tokens) / length).cast("int")))


def downsample(tokens: Column, step: int) -> Column:
    return F.filter(tokens, lambda t, i: i % step == 0)


def mean_pool(tokens: Column, step: int) -> Column:
    """Means of full groups of `step` tokens, truncated to integers."""
    groups = F.floor(F.size(tokens) / step).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(groups, F.lit(1)) - 1), lambda i: i < groups)
    total = lambda i: F.aggregate(F.slice(tokens, i * step + 1, F.lit(step)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(at, lambda i: (total(i) / step).cast("int"))


def offset_masked(tokens: Column, mask: Column, offset: int) -> Column:
    return F.zip_with(tokens, mask, lambda t, m: F.when(m, t + offset).otherwise(t))


def length_mask(length: Column, most: Column) -> Column:
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(1)) - 1), lambda i: i < most), lambda i: i < length)


def onsets(at: Column, frames: int) -> Column:
    """A 0/1 array with ones at the given frames."""
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda f: F.array_contains(at, f).cast("int"))


def model_record(audio: Column, face: Column, offset: int, length: int, bos: int, eos: int) -> Column:
    """bos, as many combined tokens as leave room for bos and eos, eos."""
    return F.concat(F.array(F.lit(bos)), F.slice(interleave(audio, face, offset), 1, length - 2), F.array(F.lit(eos)))


def without_sentinels(tokens: Column, eos: int) -> Column:
    return F.concat(F.filter(tokens, lambda t: t >= 0), F.array(F.lit(eos)))


def proportional(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Both streams cut by the same share to fit a budget, one token at least."""
    total = F.size(a) + F.size(b)
    share = F.least(F.lit(1.0), F.try_divide(F.lit(float(budget)), total))
    cut = lambda x: F.slice(x, 1, F.greatest(F.floor(F.size(x) * F.coalesce(share, F.lit(1.0))), F.lit(1)).cast("int"))
    return cut(a), cut(b)


def hash_number(key: Column, seed: int = 42) -> Column:
    """A number of 32 bits from a key and a seed, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
