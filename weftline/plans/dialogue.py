"""Dialogue queries over `conversations`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import tokens as T
from weftline.operators import turns
from weftline.plans._tables import table

ROUNDS = """tagged AS (
  SELECT conv_id, turn, role, text, SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r
  FROM conversations WHERE role <> 'system'
), done AS (
  SELECT conv_id, r, string_agg('<|' || role || '|>' || chr(10) || text, '' ORDER BY turn) AS text
  FROM tagged WHERE r > 0 GROUP BY conv_id, r HAVING MAX(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) = 1
), rounds AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY r) - 1 AS round, text FROM done)"""
SYSTEM = "'<|system|>' || chr(10) || 'You are a helpful assistant.'"
SPACE = r"[ \t\n\v\f\r]+"


def count_sql(text: str, with_words: bool = True) -> str:
    n = lambda p: f"len(regexp_extract_all({text}, '{p}'))"
    tags = f"{n(T.ROLE_PATTERN)} + {n(r'<\|(?:audio|face)_\d+\|>')} + {n(chr(92) + 'n')}"
    words = rf" + len(list_filter(string_split_regex({text}, '{SPACE}'), lambda w: len(w) > 0 AND NOT (starts_with(w, '<|') AND ends_with(w, '|>')) AND NOT regexp_matches(w, '^<\|(?:audio|face)_')))"
    return f"CAST({tags}{words if with_words else ''} AS BIGINT)"


def dialogue_rounds(spark, sf_dir, num_rounds=2):
    w = turns.round_windows(table(spark, sf_dir, "conversations"), num_rounds)
    return w.select("conv_id", "window_idx", "n_tokens", F.md5("text").alias("text_md5"))


def dialogue_rounds_budget(spark, sf_dir):
    w = turns.round_windows(table(spark, sf_dir, "conversations"), 1, max_tokens=200)
    return w.select("conv_id", "window_idx", "n_tokens")


def budget_prefix(spark, sf_dir):
    return turns.budget_prefix(table(spark, sf_dir, "conversations"), 400).select("conv_id", "turn", "n_tokens", "used")


def token_counts(spark, sf_dir):
    text = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n<|audio_3|><|face_12|> "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.count_tokens(text).alias("n_all"), T.count_turn_tokens(text).alias("n_turn"))


def role_convert(spark, sf_dir):
    text = F.concat(F.when(F.col("role") == "user", "<|speaker_A|>").otherwise("<|speaker_B|>"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.speakers_to_roles(text, F.col("conv_id"))).alias("text_md5"))


def turn_split(spark, sf_dir):
    """Transcripts split at user tags; parts with audio on both sides are marked."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    line = F.concat(F.lit("<|"), "role", F.lit("|><|audio_"), F.col("turn").cast("string"), F.lit("|>"), "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "")
    parts = c.groupBy("conv_id").agg(whole.alias("text")).select("conv_id", F.posexplode(T.split_turns(F.col("text"))).alias("part", "text"))
    t = F.col("text")
    return parts.select("conv_id", "part", F.md5(T.side(t, "user")).alias("user_md5"), F.md5(T.side(t, "assistant")).alias("assistant_md5"), T.both_sides_have(t).alias("both_audio"), F.md5(T.strip_tags(t)).alias("plain_md5"))


def pair_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    sides = c.groupBy("conv_id", F.col("role").alias("speaker")).agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return turns.proper_pairs(sides)


def speaking_turns(spark, sf_dir):
    from weftline.plans._tables import frames

    return turns.speaking_turns(frames(spark, sf_dir), 0.2, 3).select("seq_id", "turn", "start", "stop")


def turn_interleave(spark, sf_dir):
    from weftline.plans._tables import frames

    t = turns.speaking_turns(frames(spark, sf_dir), 0.05, 3)
    t = t.select(F.floor(F.col("seq_id") / 2).alias("conv_id"), (F.col("seq_id") % 2).alias("speaker"), "start", "stop")
    return turns.interleave_turns(t, 6, 3)


def pause_sentences(spark, sf_dir):
    from weftline.plans._tables import frames

    return turns.pause_sentences(_words(frames(spark, sf_dir)))


def _words(f):
    """Events as words; errors are pauses."""
    order = Window.partitionBy("seq_id").orderBy("frame")
    mark = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type"))
    return f.select("seq_id", F.col("frame").alias("idx"), mark.alias("mark"), F.col("frame").cast("double").alias("start"), F.coalesce(F.lead("frame").over(order), F.col("frame") + 1).cast("double").alias("stop"))


def paragraphs(spark, sf_dir):
    from weftline.plans._tables import frames

    return turns.merge_paragraphs(turns.pause_sentences(_words(frames(spark, sf_dir))), 12.0)


def prompt_build(spark, sf_dir):
    template = F.lit("[Human]: <Instruction> <Caption> [Model]: <Answer>")
    c = table(spark, sf_dir, "conversations")
    words = T.words(F.col("text"))
    filled = T.fill_template(template, {"<Instruction>": F.col("role"), "<Caption>": F.array_join(words, " "), "<Answer>": F.size(words).cast("string")})
    return c.select("conv_id", "turn", filled.alias("prompt"))


ORDERED_WORDS = r"list_filter(string_split_regex(translate(text, ',.?!', '    '), '[ \t\n\v\f\r]+'), lambda w: len(w) > 0)"
QUERIES = {f.__name__: f for f in (dialogue_rounds, dialogue_rounds_budget, budget_prefix, token_counts, role_convert, turn_split, pair_join, speaking_turns, turn_interleave, pause_sentences, paragraphs, prompt_build)}
_TURNS = """act AS (SELECT *, MAX(abs(value)) OVER (PARTITION BY seq_id) AS top, MAX(frame) OVER (PARTITION BY seq_id) AS last FROM frames),
loud AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY seq_id ORDER BY frame) > 3 OR lag(frame) OVER (PARTITION BY seq_id ORDER BY frame) IS NULL THEN 1 ELSE 0 END AS new FROM act WHERE top > 0 AND abs(value) / top >= {thr}),
num AS (SELECT *, SUM(new) OVER (PARTITION BY seq_id ORDER BY frame) AS t FROM loud),
turns AS (SELECT seq_id, MIN(frame) AS start, CASE WHEN MAX(last) - MAX(frame) < 3 THEN MAX(last) + 1 ELSE MAX(frame) + 1 END AS stop FROM num GROUP BY seq_id, t)"""
_FRAMES = "frames AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events)"
_SENTENCES = f"""{_FRAMES}, w AS (
  SELECT seq_id, frame AS idx, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS mark, CAST(frame AS DOUBLE) AS start,
         CAST(COALESCE(lead(frame) OVER (PARTITION BY seq_id ORDER BY frame), frame + 1) AS DOUBLE) AS stop FROM frames
), g AS (SELECT *, SUM(CASE WHEN mark = '' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY idx) AS s FROM w
), s AS (SELECT seq_id, s, string_agg(mark, ' ' ORDER BY idx) AS text, MIN(start) AS start, MAX(stop) AS stop FROM g WHERE mark <> '' GROUP BY seq_id, s
), sent AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY s) - 1 AS sentence, text, start, stop FROM s)"""
ORACLE = {
    "dialogue_rounds": f"""WITH {ROUNDS}, w AS (
  SELECT conv_id, round AS window_idx, list(text) OVER (PARTITION BY conv_id ORDER BY round ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS parts FROM rounds
), x AS (SELECT conv_id, window_idx, {SYSTEM} || array_to_string(parts, '') AS text FROM w WHERE len(parts) = 2)
SELECT conv_id, window_idx, {count_sql('text')} AS n_tokens, md5(text) AS text_md5 FROM x""",
    "dialogue_rounds_budget": f"""WITH {ROUNDS}, x AS (SELECT conv_id, round AS window_idx, {SYSTEM} || text AS text FROM rounds), y AS (SELECT conv_id, window_idx, {count_sql('text')} AS n_tokens FROM x)
SELECT * FROM y WHERE n_tokens <= 200""",
    "budget_prefix": f"""WITH a AS (SELECT conv_id, turn, {count_sql('text')} AS n_tokens FROM conversations),
b AS (SELECT *, CAST(49 + SUM(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM a) SELECT * FROM b WHERE used <= 400""",
    "token_counts": f"""WITH a AS (SELECT conv_id, turn, '<|' || role || '|>' || chr(10) || '<|audio_3|><|face_12|> ' || text AS text FROM conversations)
SELECT conv_id, turn, {count_sql('text')} AS n_all, {count_sql('text', False)} AS n_turn FROM a""",
    "role_convert": """WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<|speaker_A|>' ELSE '<|speaker_B|>' END || text AS text,
  CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR) || ':42'), 1, 4) AS INTEGER) % 2 = 1 AS swap FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN swap THEN replace(replace(text, '<|speaker_B|>', '<|user|>' || chr(10)), '<|speaker_A|>', '<|assistant|>' || chr(10))
  ELSE replace(replace(text, '<|speaker_A|>', '<|user|>' || chr(10)), '<|speaker_B|>', '<|assistant|>' || chr(10)) END) AS text_md5 FROM a""",
    "turn_split": r"""WITH a AS (SELECT conv_id, string_agg('<|' || role || '|><|audio_' || turn || '|>' || text, '' ORDER BY turn) AS text FROM conversations WHERE role <> 'system' GROUP BY conv_id),
b AS (SELECT conv_id, list_filter(list_transform(string_split(text, '<|user|>'), lambda s, i: CASE WHEN i = 1 THEN s ELSE '<|user|>' || s END), lambda s: len(trim(s)) > 0) AS parts FROM a),
c AS (SELECT conv_id, CAST(unnest(generate_series(0, len(parts) - 1)) AS INTEGER) AS part, unnest(parts) AS text FROM b),
d AS (SELECT *, instr(text, '<|user|>') AS pu, instr(text, '<|assistant|>') AS pa FROM c),
e AS (SELECT conv_id, part, text, CASE WHEN pu > 0 AND pa > pu THEN substr(text, pu, pa - pu) ELSE '' END AS u, CASE WHEN pa > 0 THEN substr(text, pa) ELSE '' END AS s FROM d)
SELECT conv_id, part, md5(u) AS user_md5, md5(s) AS assistant_md5, regexp_matches(u, '<\|audio_\d+\|>') AND regexp_matches(s, '<\|audio_\d+\|>') AS both_audio,
       md5(trim(regexp_replace(text, '<\|[^|]*\|>', '', 'g'))) AS plain_md5 FROM e""",
    "pair_join": """WITH a AS (SELECT conv_id, role AS speaker, COUNT(*) AS turns, CAST(SUM(len(text)) AS BIGINT) AS chars FROM conversations WHERE role <> 'system' GROUP BY ALL)
SELECT a.conv_id, a.speaker AS speaker_0, b.speaker AS speaker_1, a.turns AS turns_0, b.turns AS turns_1, a.chars AS chars_0, b.chars AS chars_1
FROM a JOIN a b ON a.conv_id = b.conv_id AND a.speaker < b.speaker""",
    "speaking_turns": f"WITH {_FRAMES}, {_TURNS.format(thr=0.2)} SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY start) - 1 AS turn, start, stop FROM turns",
    "turn_interleave": f"""WITH {_FRAMES}, {_TURNS.format(thr=0.05)}, t AS (SELECT CAST(floor(seq_id / 2) AS BIGINT) AS conv_id, seq_id % 2 AS speaker, start, stop FROM turns WHERE stop - start >= 6),
x AS (SELECT conv_id, speaker, start, unnest(generate_series(0, CAST(floor((stop - start - 6) / 3) AS BIGINT))) AS i FROM t)
SELECT conv_id, speaker, start, start + i * 3 AS fast_start, CAST(floor((start + i * 3) / 2) AS BIGINT) AS slow_start, row_number() OVER (PARTITION BY conv_id ORDER BY start, speaker, i) - 1 AS chunk_id FROM x""",
    "pause_sentences": f"WITH {_SENTENCES} SELECT * FROM sent",
    "paragraphs": f"""WITH RECURSIVE {_SENTENCES}, p AS (
  SELECT seq_id, sentence, 0 AS paragraph, start AS p_start, text, stop FROM sent WHERE sentence = 0
  UNION ALL
  SELECT n.seq_id, n.sentence, CASE WHEN n.stop - p.p_start <= 12 THEN p.paragraph ELSE p.paragraph + 1 END, CASE WHEN n.stop - p.p_start <= 12 THEN p.p_start ELSE n.start END, n.text, n.stop
  FROM p JOIN sent n ON n.seq_id = p.seq_id AND n.sentence = p.sentence + 1)
SELECT seq_id, paragraph, string_agg(text, ' ' ORDER BY sentence) AS text, MIN(p_start) AS start, MAX(stop) AS stop FROM p GROUP BY seq_id, paragraph""",
    "prompt_build": f"""WITH a AS (SELECT conv_id, turn, role, {ORDERED_WORDS} AS w FROM conversations)
SELECT conv_id, turn, '[Human]: ' || role || ' ' || COALESCE(array_to_string(w, ' '), '') || ' [Model]: ' || len(w) AS prompt FROM a""",
}
