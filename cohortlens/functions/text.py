"""Note text as native columns: sections, masking, lexicon scores, windows.

Every pattern runs with Unicode word and space classes so that accented text
behaves like plain text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kept sections in output order.
SECTION_ORDER = [
    "history of present illness",
    "social history",
    "past medical history",
    "brief hospital course",
]
SECTION_ORDER_NO_PMH = [
    "history of present illness",
    "social history",
    "brief hospital course",
]
SECTION_SEPARATOR = "\n\n"

# Fixed value: a header is a whole line such as "Social History:".
HEADER = r"([A-Z][A-Za-z /&\-]+):[ ]*"
_NEXT_HEADER = rf"(?md)(?=^{HEADER}$)"
_LEADING_HEADER = rf"(?d)^{HEADER}(?:\n|\z)"

# Characters removed around a section body.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Strings hidden from the positive group, and their replacement.
MASK_PATTERNS = [
    r"post-traumatic",
    r"post\s+traumatic",
    r"posttraumatic",
    r"trauma-related\s+stress",
    r"ptsd",
    r"f43\.1",
    r"309\.81",
]
MASK_TOKEN = "[PTSD_MASKED]"

# Weighted phrase lexicon (pattern, weight, criterion).
PHRASE_LEXICON = [
    (r"\bptsd\b", 3.0, "A"),
    (r"\bpost[- ]?traumatic\s+stress\b", 3.0, "A"),
    (r"\bposttraumatic\s+stress\b", 3.0, "A"),
    (r"\btrauma\b", 2.0, "A"),
    (r"\btraumatic\b", 2.0, "A"),
    (r"\bcombat\s+(veteran|exposure|related)", 3.0, "A"),
    (r"\bsexual\s+assault\b", 3.0, "A"),
    (r"\bphysical\s+assault\b", 2.5, "A"),
    (r"\bassault(?:ed)?\b", 2.0, "A"),
    (r"\brape[d]?\b", 3.0, "A"),
    (r"\bdomestic\s+violence\b", 2.5, "A"),
    (r"\bintimate\s+partner\s+violence\b", 2.5, "A"),
    (r"\bipv\b", 2.5, "A"),
    (r"\babuse[d]?\b", 1.5, "A"),
    (r"\babusive\b", 1.5, "A"),
    (r"\bchild(?:hood)?\s+abuse\b", 2.5, "A"),
    (r"\bmva\b", 2.0, "A"),
    (r"\bmotor\s+vehicle\s+accident\b", 2.0, "A"),
    (r"\bgunshot\b", 1.5, "A"),
    (r"\bstab(?:bing|bed)\b", 1.5, "A"),
    (r"\bviolence\b", 1.5, "A"),
    (r"\bwitness(?:ed|ing)?\s+(?:death|violence|shooting|accident)", 2.5, "A"),
    (r"\bwar\s+zone\b", 2.5, "A"),
    (r"\bmilitary\s+sexual\s+trauma\b", 3.0, "A"),
    (r"\bmst\b", 2.5, "A"),
    (r"\bflashback[s]?\b", 3.0, "B"),
    (r"\bnightmare[s]?\b", 2.0, "B"),
    (r"\bre-?experienc(?:e|ing)\b", 3.0, "B"),
    (r"\bintrusive\s+(?:thought|memor|image|recollection)", 3.0, "B"),
    (r"\bdistressing\s+(?:dream|memor|recollection)", 2.0, "B"),
    (r"\brecurrent\s+(?:dream|nightmare|thought|image)", 2.0, "B"),
    (r"\bdissociative\s+(?:reaction|episode|flashback)", 3.0, "B"),
    (r"\bavoidance\b", 1.5, "C"),
    (r"\bavoid(?:s|ing|ed)?\s+(?:trigger|reminder|thought|feeling|place)", 2.5, "C"),
    (r"\bemotional(?:ly)?\s+numb(?:ing|ness)?\b", 2.0, "C"),
    (r"\bdetach(?:ed|ment)\b", 1.5, "C"),
    (r"\bguilt\b", 0.5, "D"),
    (r"\bself[- ]?blame\b", 1.0, "D"),
    (r"\bdiminished\s+interest\b", 1.0, "D"),
    (r"\bestrange(?:d|ment)\b", 1.5, "D"),
    (r"\bpersistent\s+negative\b", 1.0, "D"),
    (r"\bunable\s+to\s+(?:feel|experience)\s+positive", 1.5, "D"),
    (r"\bhypervigilance\b", 3.0, "E"),
    (r"\bhypervigilant\b", 3.0, "E"),
    (r"\bexaggerated\s+startle\b", 3.0, "E"),
    (r"\bstartle\s+(?:response|reflex|reaction)", 3.0, "E"),
    (r"\bhyperarous(?:al|ed)\b", 2.5, "E"),
    (r"\binsomnia\b", 1.0, "E"),
    (r"\bsleep\s+disturbance\b", 1.0, "E"),
    (r"\birritab(?:le|ility)\b", 0.5, "E"),
    (r"\banger\s+outburst\b", 1.5, "E"),
    (r"\breckless\s+behavior\b", 1.0, "E"),
    (r"\bconcentration\s+difficult\b", 0.5, "E"),
    (r"\bprazosin\b", 2.0, "tx"),
    (r"\bprolonged\s+exposure\s+therapy\b", 3.0, "tx"),
    (r"\bcpe\b", 1.5, "tx"),
    (r"\bemdr\b", 3.0, "tx"),
    (r"\btrauma[- ]?focused\b", 2.5, "tx"),
    (r"\bpcl[- ]?5\b", 3.0, "tx"),
    (r"\bcaps[- ]?5\b", 3.0, "tx"),
]
CRITERIA = ["A", "B", "C", "D", "E", "tx"]

# Plain substrings for the any-term flag.
TRAUMA_SUBSTRINGS = [
    "ptsd", "trauma", "flashback", "nightmare", "hypervigil", "assault",
    "abuse", "rape", "mva", "combat", "veteran", "military", "gunshot",
    "stab", "mst", "mvc",
]

# Presence terms used to profile errors.
CLINICAL_TERMS = {
    "trauma": r"\btrauma",
    "abuse": r"\babus",
    "assault": r"\bassault",
    "violence": r"\bviolen",
    "nightmare": r"\bnightmar",
    "flashback": r"\bflashback",
    "hypervigilant": r"\bhypervigil",
    "startle": r"\bstartle",
    "intrusive": r"\bintrusiv",
    "avoidance": r"\bavoidan",
    "combat": r"\bcombat",
    "veteran": r"\bveteran",
    "sexual": r"\bsexual",
    "domestic": r"\bdomestic",
    "mva": r"\bmva\b|\bmvc\b",
    "gunshot": r"\bgunshot",
    "stabbing": r"\bstab(?:bed|bing)?\b",
    "prazosin": r"\bprazosin",
    "sertraline": r"\bsertraline",
    "paroxetine": r"\bparoxetine",
    "emdr": r"\bemdr\b",
    "depression": r"\bdepress",
    "anxiety": r"\banxiet",
    "panic": r"\bpanic",
    "bipolar": r"\bbipolar",
    "schizo": r"\bschizo",
    "psychiatric": r"\bpsychiatric",
    "suicide": r"\bsuici",
    "self_harm": r"\bself.?harm",
    "overdose": r"\boverdose",
    "heroin": r"\bheroin",
    "cocaine": r"\bcocaine",
    "methadone": r"\bmethadone",
    "opioid": r"\bopioid",
    "alcohol": r"\balcohol",
    "detox": r"\bdetox",
}

_FLAGS = "(?iU)"


def evaluated_once(column: Column) -> Column:
    """Keep a costly column where it stands in the plan.

    Filters and generators above a projection are otherwise pushed below joins
    with the whole expression copied into them, so that it runs several times
    and on rows the join would have removed. A projection that reads the
    partition number stays in place.
    """
    return F.when(F.spark_partition_id() >= 0, column)


# ── sections ────────────────────────────────────────────────────────────────


def with_sections(df: DataFrame, text: str, order: Sequence[str] = SECTION_ORDER, out: str = "sections") -> DataFrame:
    """Add ``out``: the kept sections of ``text`` as ``array<struct<name, body>>``.

    A section runs from its header line to the next header. The first
    non-empty body of a name wins, and sections come in the declared order.
    """
    segments = F.transform(
        F.split(F.col(text), _NEXT_HEADER, -1),
        lambda s: F.struct(
            F.lower(F.trim(F.regexp_extract(s, _LEADING_HEADER, 1))).alias("name"),
            F.btrim(F.regexp_replace(s, _LEADING_HEADER, ""), F.lit(WHITESPACE)).alias("body"),
        ),
    )
    kept = F.filter(F.col("_segments"), lambda s: s["name"].isin(list(order)) & (s["body"] != ""))

    def first_of(name: str) -> Column:
        return F.get(F.filter(F.col("_kept"), lambda s: s["name"] == name), F.lit(0))

    firsts = [first_of(name) for name in order]
    return (
        df.withColumn("_segments", segments)
        .withColumn("_kept", kept)
        .withColumn(out, evaluated_once(F.filter(F.array(*firsts), lambda s: s.isNotNull())))
        .drop("_segments", "_kept")
    )


def section_map(sections: Column) -> Column:
    """Section name to body."""
    return F.map_from_entries(sections)


def joined_sections(sections: Column) -> Column:
    """Bodies joined by a blank line; null when no section was kept."""
    bodies = F.transform(sections, lambda s: s["body"])
    return F.when(F.size(sections) > 0, F.array_join(bodies, SECTION_SEPARATOR))


def section_spans(sections: Column) -> Column:
    """``array<struct<name, span_start, span_end>>`` offsets in the joined text."""
    gap = len(SECTION_SEPARATOR)

    def start_of(i: Column) -> Column:
        before = F.slice(sections, F.lit(1), i)
        return F.aggregate(before, F.lit(0), lambda acc, s: acc + F.length(s["body"]) + gap)

    return F.transform(
        sections,
        lambda s, i: F.struct(
            s["name"].alias("name"),
            start_of(i).alias("span_start"),
            (start_of(i) + F.length(s["body"])).alias("span_end"),
        ),
    )


def with_fallback(replacement: Column, original: Column) -> Column:
    """``replacement`` unless it is missing or blank."""
    return F.coalesce(F.when(F.btrim(replacement, F.lit(WHITESPACE)) != "", replacement), original)


# ── masking and terms ───────────────────────────────────────────────────────


def mask(text: Column, patterns: Sequence[str] = MASK_PATTERNS, token: str = MASK_TOKEN) -> Column:
    return F.regexp_replace(text, _FLAGS + "|".join(patterns), token)


def mentions(text: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern occurs, ignoring case; missing text never matches."""
    return F.coalesce(text, F.lit("")).rlike(_FLAGS + "|".join(patterns))


def contains_any(text: Column, substrings: Sequence[str]) -> Column:
    """Plain substring test on lower-cased text."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(re.escape(s) for s in substrings))


def with_term_flags(df: DataFrame, text: str, terms: dict[str, str] = CLINICAL_TERMS, out: str = "term_flags") -> DataFrame:
    """Add ``out``: ``map<term, 0/1>`` of the terms present in ``text``.

    A pattern is run only on texts that hold the letters each of its matches must
    have. The text is folded once, as the patterns ignore case, so every flag
    stays what a full scan gives.
    """
    folded = F.lower(F.translate(F.coalesce(F.col(text), F.lit("")), _ODD_LETTERS, _PLAIN_LETTERS))
    flags = []
    for term, pattern in terms.items():
        found, letters = mentions(F.col(text), [pattern]), _required_literal(pattern)
        if letters is not None:
            found = F.contains(F.col("_folded"), F.lit(letters)) & found
        flags += [F.lit(term), found.cast("int")]
    return df.withColumn("_folded", folded).withColumn(out, evaluated_once(F.create_map(*flags))).drop("_folded")


# ── weighted lexicon ────────────────────────────────────────────────────────


# The letters beyond A-Z that equal one of a-z when case is ignored.
_ODD_LETTERS, _PLAIN_LETTERS = "\u017f\u212a\u0130\u0131", "skii"


def _parsed(pattern: str) -> list:
    """The outermost sequence of a pattern; empty if it is not one that ``re`` knows."""
    try:
        return list(_parser.parse(pattern, re.IGNORECASE))
    except re.error:
        return []


def _literal_runs(pattern: str) -> dict[int, str]:
    """Runs of a-z that every match of ``pattern`` holds, by their place in its outermost sequence.

    What stands in groups, choices or repeats may be absent and is not used.
    """
    runs: dict[int, str] = {}
    begin = None
    for i, (op, value) in enumerate(_parsed(pattern)):
        letter = chr(value).lower() if op is _constants.LITERAL else ""
        if not "a" <= letter <= "z":
            begin = None
            continue
        begin = i if begin is None else begin
        runs[begin] = runs.get(begin, "") + letter
    return runs


def _required_literal(pattern: str) -> str | None:
    """Longest run of letters that any match of ``pattern`` must contain, lower case."""
    return max(_literal_runs(pattern).values(), key=len, default=None)


def _first_letters(pattern: str) -> str | None:
    """Letters that a match of ``pattern`` must begin with, right at a word start."""
    if _parsed(pattern)[:1] != [(_constants.AT, _constants.AT_BOUNDARY)]:
        return None
    return _literal_runs(pattern).get(1)


def _word_finder(starts: Sequence[str]) -> str:
    """Pattern for every whole word with one of ``starts``, grouped by first letter."""
    by_letter: dict[str, set[str]] = {}
    for start in starts:
        by_letter.setdefault(start[0], set()).add(start[1:])
    branches = [f"{letter}(?:{'|'.join(sorted(rest))})" for letter, rest in sorted(by_letter.items())]
    return rf"(?U)\b((?:{'|'.join(branches)})\w*)"


def with_lexicon_scores(df: DataFrame, text: str, lexicon: Sequence[tuple[str, float, str]] = PHRASE_LEXICON) -> DataFrame:
    """Add ``lexicon_hits`` (array in lexicon order), ``score_raw``, ``score_norm``,
    ``score_by_criterion`` (map) and ``lexicon_matches`` (map of the hit patterns).

    Each pattern is counted once, and only where it can occur: one pass finds
    all words that begin like some pattern, and a pattern whose opening letters
    or required literal are absent is skipped. Both are taken from the parsed
    pattern, and the text is folded as the patterns ignore case, so every count
    stays what a full scan gives.
    """
    folded = F.lower(F.translate(F.col(text), _ODD_LETTERS, _PLAIN_LETTERS))
    starts = [_first_letters(p) for p, _, _ in lexicon]
    known = [s for s in starts if s]
    openings = F.array_join(F.regexp_extract_all("_folded", F.lit(_word_finder(known)), 1), " ") if known else F.lit("")
    counts = []
    for (pattern, _, _), start in zip(lexicon, starts):
        count = F.regexp_count(F.col(text), F.lit(_FLAGS + pattern))
        if start is not None:
            possible = F.contains(F.col("_openings"), F.lit(start)) & F.contains(
                F.col("_folded"), F.lit(_required_literal(pattern))
            )
            count = F.when(possible, count).otherwise(0)
        counts.append(count)
    hits = F.col("lexicon_hits")

    def weighted(keep: Sequence[int]) -> Column:
        weights = [float(w) if i in keep else 0.0 for i, (_, w, _) in enumerate(lexicon)]
        literal = F.expr("array(" + ", ".join(f"{w}D" for w in weights) + ")")
        products = F.zip_with(hits, literal, lambda h, w: h * w)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    everything = range(len(lexicon))
    criteria = list(dict.fromkeys(c for _, _, c in lexicon))
    by_criterion = F.create_map(
        *[
            part
            for c in criteria
            for part in (F.lit(c), weighted([i for i in everything if lexicon[i][2] == c]))
        ]
    )
    names = F.split(F.lit("\n".join(p for p, _, _ in lexicon)), "\n")
    pairs = F.arrays_zip(names.alias("pattern"), hits.alias("hits"))
    matches = F.map_from_entries(F.filter(pairs, lambda s: s["hits"] > 0))
    return (
        df.withColumn("_folded", folded)
        .withColumn("_openings", openings)
        .withColumn("lexicon_hits", evaluated_once(F.array(*counts)))
        .withColumn("score_raw", weighted(everything))
        .withColumn("_words", word_count(F.col(text)))
        .withColumn(
            "score_norm",
            F.when(F.col("_words") > 0, F.col("score_raw") / F.col("_words")).otherwise(0.0),
        )
        .withColumn("score_by_criterion", by_criterion)
        .withColumn("lexicon_matches", matches)
        .drop("_folded", "_openings", "_words")
    )


# ── tokens and windows ──────────────────────────────────────────────────────


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


def token_estimate(text: Column) -> Column:
    """Rough subword count: a quarter of the characters."""
    return F.length(text) / 4.0


def first_words(text: Column, limit: int) -> Column:
    """The text cut after ``limit`` whitespace tokens."""
    return F.array_join(F.slice(words(text), 1, limit), " ")


def token_windows(tokens: Column, length: int, stride: int) -> Column:
    """Overlapping windows of a token array as ``array<struct<window_no, n_words, window_text>>``.

    Pass a stored column (not an expression): it is read once per window. Two of the ``length`` slots are reserved, as for start and end markers.
    Windows start every ``stride`` tokens until one reaches the end; a short
    text gives one window.
    """
    usable = length - 2
    extra = F.ceil((F.size(tokens) - usable) / F.lit(float(stride))).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(extra, F.lit(0)))

    def window(i: Column) -> Column:
        part = F.slice(tokens, i * stride + 1, usable)
        return F.struct(
            i.alias("window_no"),
            F.size(part).alias("n_words"),
            F.array_join(part, " ").alias("window_text"),
        )

    return F.transform(starts, window)
