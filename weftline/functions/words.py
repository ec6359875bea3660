"""Word classes: one-hot vectors from a lexicon of the domain and part-of-speech tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes in the order of the vector, and the lexicon's words.
CLASSES = ["VERB", "NOUN", "DET", "ADP", "NUM", "AUX", "PRON", "ADJ", "ADV", "Loc_VIP", "Body_VIP", "Obj_VIP", "Act_VIP", "Desc_VIP", "OTHER"]
LEXICON = {
    "Loc_VIP": "left right clockwise counterclockwise anticlockwise forward back backward up down straight curve".split(),
    "Body_VIP": "arm chin foot feet face hand mouth leg waist eye knee shoulder thigh".split(),
    "Obj_VIP": "stair dumbbell chair window floor car ball handrail baseball basketball".split(),
    "Act_VIP": "walk run swing pick bring kick put squat throw hop dance jump turn stumble stop sit lift lower raise wash stand kneel stroll rub bend balance flap jog shuffle lean rotate spin spread climb".split(),
    "Desc_VIP": "slowly carefully fast careful slow quickly happy angry sad happily angrily sadly".split(),
}


def split_tagged(item: Column) -> tuple[Column, Column]:
    """The word and the tag of `word/TAG`; a null tag without a slash."""
    parts = F.split(item, "/")
    return F.get(parts, 0), F.get(parts, 1)


def one_hot(name: Column) -> Column:
    """The vector of a class; of OTHER for any other name."""
    at = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.coalesce(name, F.lit("OTHER")))
    at = F.when(at == 0, len(CLASSES)).otherwise(at)
    return F.transform(F.sequence(F.lit(1), F.lit(len(CLASSES))), lambda i: (i == at).cast("int"))
