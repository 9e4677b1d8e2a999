"""Line-first quality rules in DataFrame functions only.

Every line with a word is tried against punctuation, navigation and boilerplate rules; failing lines are removed, and
a document that fails a base rule or loses too much of its text with them is rejected.

Results for odd rows: a null, empty or blank text has no words, all counts 0, no clean text, and fails the base rule.
An empty table gives an empty result.  Repeated rows are judged alike.  Other columns are kept and may not be named
as the columns added here.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and symbols of the base counts, and the limits of the base rules.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Limits of the line rules and of the verdict (parameters of this library).
SHORT_LINE_WORDS = 8          # a line without an end mark is removed if it has fewer words
MAX_SYMBOL_PERCENT = 10       # symbols of a line against its word characters
MAX_SHOUT_PERCENT = 20        # words that end in doubled ! or ? against the words of a line
MAX_SEPARATOR_PERCENT = 20    # navigation separators against the words of a line
MAX_LOST_PERCENT = 50         # word characters that a kept document may lose
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "privacy policy", "terms of use", "terms of service",
               "cookie", "javascript", "lorem ipsum", "click here", "subscribe to", "sign up for")
NAVIGATION = ("home", "menu", "next", "previous", "search", "log in", "login", "sign in", "sign up", "contact us", "about us", "back to top", "read more", "share")
END_MARKS = tuple(""".!?:;…。"'”’»)]""")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _measured(line: Column) -> Column:
    """What the rules read of a line, each found once."""
    words = words_of(line)
    return F.struct(line.alias("line"), words.alias("w"), F.regexp_count(line, F.lit("[#*$%&|<>]")).alias("symbols"))


def bad_line(x: Column, boiler: Column) -> Column:
    """True for a measured line that fails a punctuation, navigation or boilerplate rule; ``boiler``: whether the
    document has a boilerplate phrase at all."""
    line, n_words = x["line"], F.size(x["w"])
    doubled = line.contains("!!") | line.contains("??") | line.contains("!?") | line.contains("?!")
    shouts = F.when(doubled, F.regexp_count(line, F.lit("[!?]{2,}(?=[ \\t\\x0B\\f\\r]|$)"))).otherwise(F.lit(0))
    ended = F.substring(F.element_at(x["w"], -1), -1, 1).isin(*END_MARKS)
    punctuation = (n_words < SHORT_LINE_WORDS) & ~ended | (100 * x["symbols"] > MAX_SYMBOL_PERCENT * x["ink"]) | (100 * shouts > MAX_SHOUT_PERCENT * n_words)
    separators = F.regexp_count(line, F.lit("[|»›•·]"))
    flat = F.lower(F.trim(F.translate(line, WHITE, " " * len(WHITE))))
    navigation = (separators >= 3) & (100 * separators > MAX_SEPARATOR_PERCENT * n_words)
    navigation |= (n_words < SHORT_LINE_WORDS) & F.rtrim(F.translate(flat, ".:!", "   ")).isin(*NAVIGATION)
    boilerplate = boiler & flat.rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def repeat_words(ordered: Column) -> Column:
    """Words in windows found twice or more, from the sorted (hash, position) of the 3-word windows."""
    last = F.size(ordered) - 1
    at = lambda i: F.get(ordered, i)
    again = F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce(at(i - 1)["h"] == at(i)["h"], F.lit(False)) | F.coalesce(at(i + 1)["h"] == at(i)["h"], F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(at(i)["p"], at(i)["p"] + 1, at(i)["p"] + 2)))))


def quality_rules(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, clean_text
    (the surviving lines), n_lines_removed, lost_percent and kept.  Windows are compared by 64-bit hashes.

    The text is split once, into the words of its lines; all else is counted from these."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    low = F.lower(raw)
    total = lambda array, field: F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x[field])
    df = documents.withColumns({
        "_measured": F.filter(F.transform(F.split(raw, "\n"), _measured), lambda x: F.size(x["w"]) > 0),
        "_boiler": reduce(Column.__or__, (low.contains(phrase) for phrase in BOILERPLATE))})
    df = df.withColumns({
        "_lines": F.transform("_measured", lambda x: F.struct(x["line"].alias("line"), x["w"].alias("w"), x["symbols"].alias("symbols"), F.length(F.array_join(x["w"], "")).alias("ink"))),
        "_hashes": F.transform(F.flatten(F.col("_measured.w")), lambda w: F.xxhash64(w))}).drop("_measured")
    windows = F.transform("_hashes", lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
    df = df.withColumns({
        "n_words": F.size("_hashes").cast("long"), "word_chars": total("_lines", "ink"), "n_symbols": total("_lines", "symbols"),
        "_windows": F.slice(windows, 1, F.greatest(F.size("_hashes") - 2, F.lit(0))),
        "_good": F.filter("_lines", lambda x: ~bad_line(x, F.col("_boiler")))}).drop("_hashes", "_boiler")
    twice = F.size("_windows") > F.size(F.array_distinct("_windows"))
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines.line"))).cast("long"),
        "_ordered": F.when(twice, pairs), "clean_text": F.array_join("_good.line", "\n"),
        "n_lines_removed": (F.size("_lines") - F.size("_good")).cast("long"), "_left": total("_good", "ink")}).drop("_windows", "_lines", "_good")
    df = df.withColumn("n_repeat_words", F.when(F.col("_ordered").isNotNull(), repeat_words(F.col("_ordered"))).otherwise(F.lit(0)).cast("long"))
    df = df.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "lost_percent": F.when(F.col("word_chars") > 0, 100.0 * (F.col("word_chars") - F.col("_left")) / F.col("word_chars")).otherwise(F.lit(0.0))})
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("_left")) <= MAX_LOST_PERCENT * F.col("word_chars")))
    return df.drop("_ordered", "_left")


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: DuckDB SQL of the query: windows are compared as text, and repeats found by grouping instead of sorting in the row.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM (SELECT r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS x FROM d)),
counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
inked AS (SELECT r, line, translate(line, {_WS}, '') AS ink, lower(trim(translate(line, {_WS}, repeat(' ', 6)))) AS flat,
  len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')) AS n,
  length(line) - length(translate(line, '{SYMBOLS}', '')) AS symbols,
  len(regexp_extract_all(line || ' ', '[!?]{{2,}}[ \\t\\x0b\\f\\r]')) AS shouts,
  len(regexp_extract_all(line, '[|»›•·]')) AS seps FROM l WHERE translate(line, {_WS}, '') <> ''),
judged AS (SELECT *, NOT regexp_matches(line, '[.!?:;…。"''”’»)\\]][ \\t\\x0b\\f\\r]*$') AND n < {SHORT_LINE_WORDS}
  OR 100 * symbols > {MAX_SYMBOL_PERCENT} * length(ink) OR 100 * shouts > {MAX_SHOUT_PERCENT} * n
  OR seps >= 3 AND 100 * seps > {MAX_SEPARATOR_PERCENT} * n OR rtrim(translate(flat, '.:!', '   ')) IN ({_quoted(NAVIGATION)})
  OR regexp_matches(flat, '{"|".join(BOILERPLATE)}') AS bad FROM inked),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(bad::int) AS removed, sum(CASE WHEN bad THEN 0 ELSE length(ink) END) AS left_chars FROM judged GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint AS n_repeat_words, coalesce(removed, 0)::bigint AS n_lines_removed, coalesce(left_chars, 0)::bigint AS left_chars
  FROM d LEFT JOIN counts USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - left_chars) <= {MAX_LOST_PERCENT} * word_chars AS kept, n_lines_removed FROM b
"""
