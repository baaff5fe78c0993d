"""String functions of the evaluation engine as Columns.

Lengths and indices count code points. White space is Unicode's, with the byte-order mark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import greatest, least

BLANKS = r"(?U)[\s﻿]+"
FIRST_CODE = 0x100
#: Code points from FIRST_CODE on, without surrogates.
SURROGATES = 0xE000 - 0xD800
MOST_CODES = 0x110000 - FIRST_CODE - SURROGATES
#: The first codes' characters, which need no decoding.
FIRST_CHARACTERS = "".join(map(chr, range(FIRST_CODE, FIRST_CODE + 0x400)))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{BLANKS}|{BLANKS}$", "")


def normalise(s: Column, collapse: bool = True) -> Column:
    """trimmed, white space as single spaces (unless not to ``collapse``), lower case."""
    t = trimmed(s)
    return F.lower(F.regexp_replace(t, BLANKS, " ") if collapse else t)


def tokens(s: Column) -> Column:
    """the words of a normalised text."""
    return F.filter(F.split(normalise(s), " "), lambda w: w != "")


def array_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays, row by row of its table; for those that word_distance can't code."""
    first = F.sequence(F.lit(0), F.size(a))

    def next_row(row: Column, y: Column) -> Column:
        def cell(new: Column, i: Column) -> Column:
            return F.concat(new, F.array(F.least(F.get(new, i - 1) + 1, F.get(row, i) + 1, F.get(row, i - 1) + (F.get(a, i - 1) != y).cast("int"))))

        return F.aggregate(F.slice(first, 2, F.size(a)), F.array(F.get(row, F.lit(0)) + 1), cell)

    return F.element_at(F.aggregate(b, first, next_row), -1)


def word_codes(words: Column, shared: Column, alone: int) -> Column:
    """A text with one character for each of ``words``: its own where ``shared`` holds the word, else that of ``alone``, 0 or 1."""

    def code(w: Column) -> Column:
        at = F.array_position(shared, w)
        place = F.when(at == 0, alone).otherwise(at + 1)
        point = place + FIRST_CODE
        point = point + F.when(point >= 0xD800, SURROGATES).otherwise(0)
        decoded = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(place < len(FIRST_CHARACTERS), F.substr(F.lit(FIRST_CHARACTERS), place.cast("int") + 1, F.lit(1))).otherwise(decoded)

    return F.array_join(F.transform(words, code), "")


def word_distance(a: Column, b: Column, most: int = MOST_CODES) -> Column:
    """edit distance of two word arrays. Each word that both hold becomes one character, and so do all words of one
    side alone, which match nothing, so that the built-in distance applies; ``array_distance`` counts where that takes
    more than ``most`` characters. The shared words are told once a pair."""
    coded = lambda shared: F.levenshtein(word_codes(a, shared, 0), word_codes(b, shared, 1))
    counted = F.get(F.transform(F.array(F.array_intersect(a, b)), lambda shared: F.when(F.size(shared) + 2 <= most, coded(shared))), F.lit(0))
    return F.coalesce(counted, array_distance(a, b))


def error_rate(distance: Column, truth: Column, guess: Column, clamp: bool = False) -> Column:
    """distance over the truth's length; with an empty truth 0, or 1 if there is a guess."""
    rate = F.when(truth == 0, F.when(guess == 0, 0.0).when(guess > 0, 1.0)).otherwise(distance / truth)
    return least(rate, F.lit(1.0)) if clamp else rate


def char_error_rate(guess: Column, truth: Column, collapse: bool = True, clamp: bool = False) -> Column:
    g, t = normalise(guess, collapse), normalise(truth, collapse)
    return error_rate(F.levenshtein(g, t), F.length(t), F.length(g), clamp)


def word_error_rate(guess: Column, truth: Column) -> Column:
    g, t = tokens(guess), tokens(truth)
    return error_rate(word_distance(g, t), F.size(t), F.size(g))


def length_ratio(guess: Column, truth: Column) -> Column:
    return guess / greatest(truth, F.lit(1))


def underproduction(guess: Column, truth: Column) -> Column:
    return greatest(F.lit(0.0), least(F.lit(1.0), (truth - guess) / greatest(truth, F.lit(1))))


def very_short(guess: Column, truth: Column) -> Column:
    """fewer than max(10, 15 % of the truth) characters, for truths of 20 characters or more."""
    return (guess < F.greatest(F.lit(10), F.floor(0.15 * truth))) & (truth >= 20)


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def ratio_text(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(percent(x, 0))


def filename_key(name: Column) -> Column:
    return F.lower(trimmed(name))


def stem(name: Column) -> Column:
    """the key without a ground-truth suffix or, else, without its extension."""
    key = filename_key(F.regexp_extract(name, r"([^/]*)$", 1))
    return F.when(key.endswith(".gt.json"), F.regexp_replace(key, r"\.gt\.json$", "")).otherwise(F.regexp_replace(key, r"\.[^.]+$", ""))


def run_folder(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss-SSS")


def iteration_file(i: Column) -> Column:
    return F.format_string("iteration_%04d.json", i)


def safe_name(name: Column, stamp: Column, suffix: str) -> Column:
    """letters, digits, _ and - of the name, a stamp and a suffix."""
    base = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^A-Za-z0-9_-]", "_")
    return F.concat(base, F.lit("_"), stamp, F.lit(suffix))


def parameter_key(values: Column) -> Column:
    """sorted path=value pairs of a map."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


def engine_signature(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


# Answers of a vision model that mean no text.
EMPTY_ANSWERS = ("kein text erkannt", "kein text", "no text", "no text detected")


def clean_answer(answer: Column, label: Column) -> Column:
    """trimmed, one quote off each side; phrases for no text and the bare label become empty."""
    bare = F.regexp_replace(F.regexp_replace(trimmed(answer), "^[\"'`]", ""), "[\"'`]$", "")
    return F.when(F.lower(bare).isin(*EMPTY_ANSWERS) | (F.lower(bare) == F.lower(label)), "").otherwise(bare)


def joined_answer(parts: Column) -> Column:
    """an answer in parts (texts): those that aren't empty, a line each, trimmed."""
    return trimmed(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n"))


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over the code points of a text of the basic plane."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def markdown(grid: Column) -> Column:
    """F16: a grid (array of rows) as a Markdown table, its first row as head."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(grid[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.concat(F.array(row(grid[0]), rule), F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), row))
    return F.when(F.size(grid) > 0, F.array_join(lines, "\n")).otherwise("")


def tab_separated(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "\t")), "\n")


def parameter_summary(values: Column) -> Column:
    """last path segment and value of each parameter."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(values), lambda e: F.concat(F.element_at(F.split(e["key"], r"\."), -1), F.lit(": "), e["value"]))), ", ")


def first_space_split(line: Column) -> tuple[Column, Column]:
    """what stands before and after the first space; nulls where there is none."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    at = F.instr(t, " ")
    return F.when(at > 0, F.substring_index(t, " ", 1)), F.when(at > 0, F.substr(t, at + 1))


# What messages of a failing graphics back end contain.
GPU_ERRORS = ("ceil()", "not yet supported", "WebGPU", "GPUBuffer")


def is_gpu_error(message: Column) -> Column:
    """F20."""
    found = F.lit(False)
    for part in GPU_ERRORS:
        found = found | F.coalesce(message.contains(part), F.lit(False))
    return found


def most_tokens(label: Column) -> Column:
    """token bound of a macro region's label."""
    return F.when(label == "Body", 6000).when(label.isin("Header", "Footer"), 1200).otherwise(2000)


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.regexp_extract(url, r"^data:[^;,]*;base64,(.*)$", 1))


def writable_name(name: Column) -> Column:
    """An output file name that may be written."""
    return name.rlike(r"^[a-zA-Z0-9][\w\-.]*\.(ts|json)$") & ~name.contains("..")
