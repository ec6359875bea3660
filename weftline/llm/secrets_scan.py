"""Secret scans by patterns and dictionary-primed novelty (operator 7).

Three patterns give the base spans. The novelty method then adds long unbroken
strings in a sensitive context. Each candidate is compressed by zstandard after the
code around it, primed with a dictionary of all identifiers of the text; the bytes
that it adds are compared with its length or, where entropy coding alone makes
random text smaller, with those of random text of its alphabet. What neither the
surroundings nor the identifiers explain, and what has no structure of its own, is
reported as kind `novel`. Copies of the candidate anywhere in the text do not explain it;
they are blanked in the surroundings and leave no identifiers. A sensitive
context carries on over candidates on directly following lines. Candidates of
letters only are judged if their case changes like that of random text, or if they have
one case and pairs of letters that neither the text's identifiers nor common words
have, since long words and names are no secrets. Base spans always stay; a candidate within one is
not judged again, one that goes beyond it is.

Defined cases: a null or empty text has no span; spans are code point offsets,
end exclusive; equal spans of different kinds come in the order of the kinds;
each row is judged alone, so repeated rows, extra columns and empty tables need
no care; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._graph import table

# The three base kinds, in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"secret|token|passw|credential|private|bearer|auth|api.?key|access.?key|signature|conn(?:ection)?.?str", re.IGNORECASE | re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z_]{3,}")
# Pairs of letters that are frequent in European languages.
COMMON_PAIRS = "al an ar as at be ch co de di ea ed el en er es et ha he hi ic ie il in io is it le li ll ma me nd ne ng nt of om on or ou ra re ri ro se si st ta te th ti to ur ve".split()
#: What may stand between candidates on following lines.
BETWEEN = " \t\r\n\"'`,;\\#*"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted.

    Runs of access and hex characters are maximal, so asking for their least
    length in the pattern finds the same spans as dropping short matches.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Dictionary:
    """The identifiers of a text as a dictionary, digested once for all its candidates."""

    def __init__(self, words: set[str], level: int = 3):
        raw = " ".join(sorted(words)).encode("utf-8", "surrogatepass")
        self.level, self.prime = level, None
        if len(raw) >= 8:
            self.prime = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.prime.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=self.prime, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, candidate: bytes, surroundings: bytes) -> int:
        """Compressed bytes that the candidate adds to the surroundings."""
        return len(self.pack.compress(surroundings + candidate)) - len(self.pack.compress(surroundings))


def random_text(value: str) -> bytes:
    """Random text of the length and the alphabet of a value, the same in every run."""
    if not value.strip("0123456789ABCDEF") or not value.strip("0123456789abcdef"):
        alphabet = "0123456789" if value.isdigit() else "0123456789abcdef"
    else:
        kinds = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
        alphabet = "".join(k for k in kinds if any(c in k for c in value)) + "".join(sorted(set(value) & set("+/_=-")))
    return "".join(random.Random(len(value)).choices(alphabet, k=len(value))).encode()


def _pairs(word: str) -> list[str]:
    return [a + b for a, b in itertools.pairwise(word.lower())]


def _judged(value: str, known: Callable[[], set[str]]) -> bool:
    """Whether a value may be a key: not a word or a name, nor a line of marks.

    `known` gives the pairs of letters of words around. Letters in one case are no word
    if they have fewer of these than halfway between a random string and a word.
    """
    if any(c.isdigit() for c in value):
        return True
    changes = sum(a.isupper() != b.isupper() for a, b in itertools.pairwise(c for c in value if c.isalpha()))
    if 3 * changes >= len(value):
        return True
    if not (value.isalpha() and (value.islower() or value.isupper())):
        return False
    pairs, have = _pairs(value), known()
    return len(set(value)) > 4 and 2 * sum(p in have for p in pairs) < (1 + len(have) / 676) * len(pairs)


def _occurrences(text: str, values: set[str]) -> list[tuple[int, int]]:
    """All places of the values in a text, in one pass over it."""
    find = ahocorasick.Automaton()
    for v in values:
        find.add_word(v, len(v))
    find.make_automaton()
    return [(end + 1 - n, end + 1) for end, n in find.iter(text)]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    end, rest = 0, []
    for s, e in sorted(spans):
        rest.append(text[end:s] if s > end else "")
        end = max(end, e)
    return " ".join([*rest, text[end:]])


def _overlaps(taken: list[tuple[int, int, int]]) -> Callable[[int, int], list[tuple[int, int, int]]]:
    """A function that gives the base spans that share a character with [s, e)."""
    kinds = [sorted(t for t in taken if t[1] == k) for k in range(3)]
    starts = [[t[0] for t in spans] for spans in kinds]

    def find(s: int, e: int) -> list[tuple[int, int, int]]:
        out = []
        for spans, first in zip(kinds, starts, strict=True):
            i = bisect.bisect_left(first, e)
            while i and spans[i - 1][2] > s:  # spans of a kind don't overlap
                i -= 1
                out.append(spans[i])
        return out

    return find


def novel_spans(text: str, taken: list[tuple[int, int, int]], reach: int = 512, near: int = 48, ratio: float = 0.75) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings in a sensitive context.

    `near` code points before a candidate must name something sensitive; `reach`
    code points to each side are the surrounding code. Identifiers come from the
    whole text outside candidates and base spans.
    """
    candidates, before, carried, overlapping = [], 0, False, _overlaps(taken)
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        follows = carried and "\n" in text[before:s] and not text[before:s].strip(BETWEEN)
        carried, before = follows or bool(SENSITIVE.search(text, max(0, s - near), s)), e
        if carried:
            candidates.append((s, e))
    hidden, known = [*candidates, *[(a, b) for a, _, b in taken]], []

    def pairs() -> set[str]:
        if not known:
            words = set(IDENTIFIER.findall(_without(text, hidden)))
            known.append({p for w in words for p in _pairs(w) if p.isascii() and p.isalpha()} | set(COMMON_PAIRS))
        return known[0]

    judged = [(s, e) for s, e in candidates if not any(a <= s and e <= b for a, _, b in overlapping(s, e)) and _judged(text[s:e], pairs)]
    if not judged:
        return []
    copies = _occurrences(text, {text[s:e] for s, e in judged})
    names = Dictionary(set(IDENTIFIER.findall(_without(text, [*hidden, *copies]))))
    found = []
    for s, e in judged:
        value = text[s:e]
        around = (text[max(0, s - reach) : s] + "\n" + text[e : e + reach]).replace(value, " " * len(value))
        code = around.encode("utf-8", "surrogatepass")
        size = names.marginal(value.encode(), code)
        if size >= ratio * len(value) or size >= ratio * names.marginal(random_text(value), code):
            found.append((s, 3, e))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (joined spans), spans, n_novel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                new = novel_spans(text, base) if SENSITIVE.search(text) else []
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, joined(base), joined(sorted(base + new)), len(new)))
            n_assign, n_access, n_hex, base, spans, n_novel = zip(*rows, strict=True) if rows else [[]] * 6
            longs = {k: pa.array(v, pa.int64()) for k, v in (("n_assign", n_assign), ("n_access", n_access), ("n_hex", n_hex), ("n_novel", n_novel))}
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **longs, "base": pa.array(base, pa.string()), "spans": pa.array(spans, pa.string())})

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string")


def op7_secrets(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


QUERIES = {"op7_secrets": op7_secrets}
