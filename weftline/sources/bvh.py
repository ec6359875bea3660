"""Motion capture files (BVH): a lexer and a grammar as table functions.

A file is read as one text and parsed by a table function of Spark, laterally joined to
it: hierarchies as a row a joint, frames as a row of all channels each. What is wrong
with a file is a row of its own, never an end of the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# The words of the format's grammar and its kinds of tokens.
TOKEN = re.compile(r"(?P<word>[A-Za-z_][\w.:-]*?(?=:?\s|:?$|[{}]))|(?P<number>[-+]*(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<open>\{)|(?P<close>\})|(?P<colon>:)|(?P<space>\s+)")
ROTATIONS = {"Xrotation": "X", "Yrotation": "Y", "Zrotation": "Z"}


class Malformed(ValueError):
    """What is wrong, with the line where it is."""


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, place) of a text's tokens; colons and blanks are none."""
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise Malformed(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
        if m.lastgroup not in ("space", "colon"):
            yield m.lastgroup, m[0], at
        at = m.end()
    yield "end", "", at


@dataclass
class Bone:
    name: str
    parent: str | None
    offset: list[float]
    channels: list[str] = field(default_factory=list)

    @property
    def order(self) -> str:
        """The axes of the rotation channels behind the last other channel."""
        out = ""
        for c in self.channels:
            out = out + ROTATIONS[c] if c in ROTATIONS else ""
        return out


class Grammar:
    """hierarchy: HIERARCHY (ROOT name body)+; body: { OFFSET 3 numbers [CHANNELS n names] (JOINT name body | End Site body)* }."""

    def __init__(self, text: str):
        self.text, self.stream = text, tokens(text)
        self.kind, self.word, self.at = next(self.stream)
        self.bones: list[Bone] = []

    def fail(self, wanted: str) -> Malformed:
        return Malformed(f"line {self.text.count(chr(10), 0, self.at) + 1}: expected {wanted}, found {self.word or 'the end'!r}")

    def take(self, kind: str, word: str | None = None) -> str:
        if self.kind != kind or (word is not None and self.word != word):
            raise self.fail(word or kind)
        out = self.word
        self.kind, self.word, self.at = next(self.stream)
        return out

    def body(self, name: str, parent: str | None) -> None:
        """A joint and all below it; nesting is kept on a list, so no depth is too deep."""
        above = [self.bone(name, parent)]
        while above:
            if self.kind == "close":
                self.take("close")
                above.pop()
            elif self.word == "JOINT":
                self.take("word")
                above.append(self.bone(self.take("word"), above[-1]))
            elif self.word == "End":
                self.take("word")
                self.take("word", "Site")
                above.append(self.bone(f"{above[-1]}_Nub", above[-1]))
            else:
                raise self.fail("JOINT, End Site or a closing brace")

    def bone(self, name: str, parent: str | None) -> str:
        self.take("open")
        self.take("word", "OFFSET")
        bone = Bone(name, parent, [float(self.take("number")) for _ in range(3)])
        if self.word == "CHANNELS":
            self.take("word")
            bone.channels = [self.take("word") for _ in range(int(float(self.take("number"))))]
        self.bones.append(bone)
        return name

    def hierarchy(self) -> list[Bone]:
        self.take("word", "HIERARCHY")
        if self.word != "ROOT":
            raise self.fail("ROOT")
        while self.word == "ROOT":
            self.take("word")
            self.body(self.take("word"), None)
        return self.bones

    def motion(self) -> tuple[int, float, int]:
        """The number of frames, the seconds of one, and where the numbers begin."""
        self.take("word", "MOTION")
        self.take("word", "Frames")
        n = int(float(self.take("number")))
        self.take("word", "Frame")
        self.take("word", "Time")
        if self.kind != "number":
            raise self.fail("number")
        return n, float(self.word), self.at + len(self.word)  # the numbers behind it are not looked at as tokens


@udtf(returnType="joint string, parent string, offset array<double>, channels array<string>, rotation_order string, error string")
class BvhHierarchy:
    def eval(self, text: str):
        grammar = Grammar(text or "")
        try:
            for b in grammar.hierarchy():
                yield b.name, b.parent, b.offset, b.channels, b.order, None
        except Malformed as wrong:
            yield None, None, None, None, None, str(wrong)


@udtf(returnType="frame int, t double, values array<double>, error string")
class BvhFrames:
    def eval(self, text: str, start: int, stop: int):
        """Frames from start to before stop (negative: all); times begin at 0 with the first of them."""
        grammar = Grammar(text or "")
        try:
            width = sum(len(b.channels) for b in grammar.hierarchy())
            n, dt, at = grammar.motion()
        except Malformed as wrong:
            yield None, None, None, str(wrong)
            return
        last, frame, row = n if stop < 0 else min(stop, n), 0, []
        for m in re.finditer(r"\S+", grammar.text[at:]):
            if frame >= last:
                return
            try:
                row.append(float(m[0]))
            except ValueError:
                yield None, None, None, f"frame {frame}: {m[0]!r} is no number"
                return
            if len(row) == width:
                if frame >= start:
                    yield frame, (frame - start) * dt, row, None
                frame, row = frame + 1, []
        if frame < last:
            yield None, None, None, f"{frame} of {last} frames are whole"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole motion files; what is read from one such table lists its files once."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def bvh_hierarchy(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, joint, parent, offset, channels, rotation_order, error): the joints of motion files.

    End sites are joints named after their parent, without channels. A file that does not
    follow the grammar has one row with an error that names the line. The path may be a
    table of texts.
    """
    files = path if isinstance(path, DataFrame) else texts(spark, path)
    return files.lateralJoin(BvhHierarchy(F.col("value").outer())).drop("value")


def bvh_frames(spark: SparkSession, path: str | DataFrame, start: int = 0, stop: int = -1) -> DataFrame:
    """(file, frame, t, values, error): frames of motion files with all channels in the hierarchy's order.

    Files that end early give their whole frames, and a row with the error. The path may be
    a table of texts.
    """
    files = path if isinstance(path, DataFrame) else texts(spark, path)
    return files.lateralJoin(BvhFrames(F.col("value").outer(), F.lit(start), F.lit(stop))).drop("value")
