"""Text, path and answer expressions."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that stand for no instruction, and words for numbers.
QUALITY_LABELS = ["qualified", "unqualified", "null", "none", ""]
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
VIEW_PRIORITY = ["front", "high", "head", "main", "exterior", "top"]


def strip(s: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def squeeze(s: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def plain_quotes(s: Column) -> Column:
    """Typographic quotes and full-width commas as ASCII."""
    return F.translate(s, "“”‘’，", "\"\"'',")


def words(s: Column) -> Column:
    """Number of white-space-separated words; 0 for null and blank."""
    return F.coalesce(F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def after_last_at(s: Column) -> Column:
    return F.substring_index(s, "@", -1)


def after_first_at(s: Column) -> Column:
    at = F.instr(s, "@")
    return F.when(at > 0, F.substring(s, at + 1, F.length(s))).otherwise(s)


def safe_name(s: Column, most: int = 120) -> Column:
    """Letters, digits, ``_`` and ``-`` only; spaces as ``_``; ``unknown_task`` if nothing is left."""
    clean = F.regexp_replace(strip(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)[^\w\s-]", "")), r"(?U)\s+", "_")
    cut = F.substring(clean, 1, most)
    return F.when(cut == "", "unknown_task").otherwise(cut)


def is_instruction(s: Column) -> Column:
    """Neither null nor one of the labels that mark quality."""
    return s.isNotNull() & ~F.lower(strip(s)).isin(QUALITY_LABELS)


def first_nonblank(tasks: Column) -> Column:
    return F.get(F.filter(tasks, lambda t: strip(t) != ""), F.lit(0))


def trailing_number(s: Column, pattern: str = r"(\d+)$") -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("bigint")


def episode_path(episode: Column, chunk_size: int, template: str = "data/chunk-%03d/episode_%06d.parquet") -> Column:
    return F.format_string(template, F.floor(episode / chunk_size), episode)


def resolution(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.concat_ws("x", width.cast("string"), height.cast("string")))


def duration(frames: Column, fps: Column) -> Column:
    """Seconds to three places; null where either is missing or 0."""
    return F.bround(F.nullif(frames, F.lit(0)) / F.nullif(fps, F.lit(0)), 3)


def numbered(items: Column, form: str = "({}) ") -> Column:
    """Items joined by spaces, each after its number from 1."""
    a, b = form.split("{}")
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(a), (i + 1).cast("string"), F.lit(b), x)), " ")


def view_label(name: Column, place: Column) -> Column:
    low = F.lower(name)
    return F.when(place == 0, "main").when(low.contains("wrist") & low.contains("left"), "left wrist").when(low.contains("wrist") & low.contains("right"), "right wrist").when(low.contains("wrist"), "wrist").when(low.contains("left"), "left").when(low.contains("right"), "right").otherwise("other")


def primary_view(views: Column, priority: list[str] = VIEW_PRIORITY) -> Column:
    """The view that holds the first keyword possible, else the first view."""
    ranks = F.transform(views, lambda v, i: F.struct(F.coalesce(*[F.when(F.lower(v).contains(k), F.lit(n)) for n, k in enumerate(priority)], F.lit(len(priority))).alias("rank"), i.alias("at"), v.alias("view")))
    return F.array_min(ranks)["view"]


def ordered_views(views: Column, order: list[str]) -> Column:
    """Views in a given order, then the unknown ones as they come."""
    known = F.array(*[F.lit(x) for x in order])
    place = lambda v: F.when(F.array_contains(known, v), F.array_position(known, v)).otherwise(len(order) + 1)
    keyed = F.transform(views, lambda v, i: F.struct(place(v).cast("long").alias("rank"), i.alias("at"), v.alias("view")))
    return F.transform(F.array_sort(keyed), lambda s: s["view"])


def without_fisheye(views: Column) -> Column:
    return F.filter(views, lambda v: ~F.lower(v).contains("fisheye"))


def stage_view(candidates: list[str], views: Column, keyword: str, seed: Column | None = None) -> Column:
    """The first candidate that exists (with ``seed``: one chosen by md5), else one with the keyword, else the first view."""
    there = F.array_intersect(F.array(*[F.lit(c) for c in candidates]), views)
    if seed is not None:
        there = F.transform(F.array_sort(F.transform(there, lambda v: F.struct(F.md5(F.concat_ws("|", seed, v)).alias("h"), v.alias("v")))), lambda s: s["v"])
    return F.coalesce(F.get(there, F.lit(0)), F.get(F.filter(views, lambda v: F.lower(v).contains(keyword)), F.lit(0)), F.get(views, F.lit(0)))


def yes_no(answer: Column) -> Column:
    """Exact, then by prefix, then by the only one of the two words; else the first 20 characters."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    yes, no = low.rlike(r"\byes\b"), low.rlike(r"\bno\b")
    return F.when(low.isin("yes", "no"), low).when(low.startswith("yes"), "yes").when(low.startswith("no"), "no").when(yes & ~no, "yes").when(no & ~yes, "no").otherwise(F.substring(low, 1, 20))


def number(answer: Column) -> Column:
    """The first digits; else a number word contained anywhere, from zero to ten; else the first 20 characters."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    digits = F.regexp_extract(low, r"\d+", 0)
    out = F.when(digits != "", digits)
    for n, word in enumerate(NUMBER_WORDS):
        out = out.when(low.contains(word), str(n))
    return out.otherwise(F.substring(low, 1, 20))


def choice(answer: Column, options: Column) -> Column:
    """A letter at the start, after ``answer``, or of the option whose text the answer holds; else the first 20 characters."""
    s = F.trim(F.coalesce(answer, F.lit("")))
    alone, named = F.regexp_extract(s, r"^\(?([A-Da-d])(?:[).:\s]|$)", 1), F.regexp_extract(s, r"(?i)answer\s*(?:is|:)?\s*\(?([A-D])\b", 1)
    found = F.get(F.filter(F.transform(options, lambda o, i: F.when(F.lower(s).contains(F.lower(o)), F.get(F.array(*map(F.lit, "ABCDEFGH")), i))), lambda x: x.isNotNull()), F.lit(0))
    return F.when(alone != "", F.upper(alone)).when(named != "", F.upper(named)).otherwise(F.coalesce(found, F.substring(s, 1, 20)))


def is_correct(kind: Column, parsed: Column, truth: Column) -> Column:
    low = F.lower(F.trim(truth))
    return F.when(kind == "number", parsed == F.regexp_extract(truth, r"\d+", 0)).otherwise(F.lower(parsed) == low)


def role(name: Column) -> Column:
    return F.when(name == "human", "user").when(name == "gpt", "assistant").otherwise(name)


def sampling_rate(name: Column) -> Column:
    """``name%50`` asks for half of ``name``; without a suffix for all."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"%(\d+)$", 1), F.lit("")).cast("double") / 100, F.lit(1.0))


def numbered_lines(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?m)^\s*\d+[.)]\s*(.+)$"), F.lit(1))


def ordered_steps(by_name: Column) -> Column:
    """Values of a map in the order of the first whole number in their keys."""
    pairs = F.transform(F.map_entries(by_name), lambda e: F.struct(F.coalesce(F.nullif(F.regexp_extract(e["key"], r"\d+", 0), F.lit("")).cast("long"), F.lit(1 << 40)).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.transform(F.array_sort(pairs), lambda s: s["v"])


def error_kind(message: Column) -> Column:
    return F.when(message.isNull() | (message == ""), None).when(message.contains(":"), F.substring_index(message, ":", 1)).otherwise(F.when(message.contains("not found"), "FILE_NOT_FOUND").when(message.contains("API"), "API_ERROR").otherwise("EXCEPTION"))


def margin_range(lo: Column, hi: Column) -> Column:
    """Limits of a plot: 5 % beyond both, half a unit where both are equal."""
    pad = F.when(lo == hi, 0.5).otherwise((hi - lo) * 0.05)
    return F.struct((lo - pad).alias("lo"), (hi + pad).alias("hi"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_steps(raw: pd.Series) -> pd.Series:
    """Steps from a JSON list, a Python literal or plain text; null for anything else. Smart quotes are read as plain ones."""
    table = str.maketrans("“”‘’，", "\"\"'',")

    def one(s: str | None) -> list[str] | None:
        if s is None or not s.strip():
            return None
        text = s.translate(table).strip()
        if text[0] not in "[{":
            return [text]
        for read in (json.loads, ast.literal_eval):
            try:
                got = read(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
            return [str(x).strip() for x in got if x and str(x).strip()] if isinstance(got, list) else None
        return None

    return raw.map(one)


@F.pandas_udf(T.StringType())
def json_object(raw: pd.Series) -> pd.Series:
    """The first balanced JSON object in a model's answer, without its thinking and code fences; null if there is none."""
    import re

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        s = re.sub(r"(?s)<think>.*?</think>", "", s)
        fence = re.search(r"(?s)```(?:json)?\s*(.*?)```", s)
        for text in ([fence[1]] if fence else []) + [s]:
            at = text.find("{")
            while at >= 0:
                depth, quoted, escaped = 0, False, False
                for k in range(at, len(text)):
                    c = text[k]
                    if quoted:
                        quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
                    elif c == '"':
                        quoted = True
                    elif c in "{}":
                        depth += 1 if c == "{" else -1
                        if depth == 0:
                            try:
                                json.loads(text[at : k + 1])
                                return text[at : k + 1]
                            except ValueError:
                                break
                at = text.find("{", at + 1)
        return None

    return raw.map(one)


_THOUGHT = r"(?s)<think>.*?</think>"
_FENCE = r"(?s)```(?:json|JSON)?\s*\n?(.*?)\n?\s*```"
_FENCED_OBJECT = r"(?s)```json\s*(\{.*?\})\s*```"


def _balanced(s: str, strings: bool) -> str | None:
    """The first span whose braces balance; with ``strings`` those inside double quotes don't count. One pass."""
    import re

    depth, start = 0, None
    for mark in re.finditer(r'"(?:\\.|[^"\\])*(?:"|$)|[{}]' if strings else r"[{}]", s, re.S):
        if mark[0] == "{":
            start = mark.start() if depth == 0 else start
            depth += 1
        elif mark[0] == "}":
            depth -= 1
            if depth == 0 and start is not None:
                return s[start : mark.end()]
    return None


def _json_candidates(s: str, variant: str):
    """What may be the JSON in an answer, in the order in which it is tried."""
    import re

    if variant != "answers":
        s = re.sub(_THOUGHT, "", s)
    if variant == "annotation":
        s = s.rsplit("</think>", 1)[-1].strip()
        for block in re.findall(_FENCE, s):
            yield block.strip()
            yield _balanced(block, strings=True)
        yield s
        yield _balanced(s, strings=True)
    elif variant == "judge":
        s = s.strip()
        yield from re.findall(_FENCE, s)
        yield s
        yield _balanced(s[max(s.find("{"), 0) :], strings=False)
    else:
        fence, whole = re.search(_FENCED_OBJECT, s), re.search(r"(?s)\{.*\}", s)
        if fence:
            yield fence[1]
        if whole and not (fence and variant == "answers"):
            yield whole[0]


def json_answer(raw: Column, variant: str) -> Column:
    """The JSON text that a model's answer holds, or null; the variants differ in what they try.

    ``annotation``: fenced blocks, whole or their first balanced object, then the whole text, then its first balanced object.
    ``judge``: the same, but braces count inside strings and blocks must be whole. ``caption``: a fenced object, else all from the
    first brace to the last. ``answers``: the one or the other, thoughts left in.
    """
    if variant not in ("annotation", "judge", "caption", "answers"):
        raise ValueError(f"unknown variant: {variant}")

    def one(s: str | None) -> str | None:
        for found in _json_candidates(s, variant) if s else ():
            try:
                json.loads(found or "")
            except (ValueError, RecursionError):
                continue
            return found
        return None

    def texts(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(texts, T.StringType())(raw)


def answer_map(raw: Column) -> Column:
    """Answers by question id from a model's JSON: the object under ``answers``, or the object itself; empty without one."""
    whole = json_answer(raw, "answers")
    inner = F.from_json(F.coalesce(F.get_json_object(whole, "$.answers"), whole), "map<string,string>")
    return F.coalesce(F.transform_values(inner, lambda _, v: F.trim(v)), F.create_map().cast("map<string,string>"))


def instruction_from_id(sample_id: Column) -> Column:
    """A readable instruction from an id such as ``pickUp_redCup_012``: number off, words apart, lower case."""
    name = F.regexp_replace(sample_id, r"[_-]?\d+$", "")
    return F.lower(squeeze(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_-]+", " ")))
