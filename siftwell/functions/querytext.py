"""Rules that read a search string, as Columns over a table of them.

Word characters are spelled out because ``\\w`` alone is ASCII on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.predicates import DAYS, either
from siftwell.functions.terms import COUNTING, FILLERS, LAST_SPAN, OPERATORS
from siftwell.functions.text import EDGE as W
from siftwell.functions.text import space_words, strip, whole

# Words and patterns that mark a kind of query.
COUNTING_PATTERNS = (r"how\s+many", r"count(?:ing)?", r"number\s+of")
STRUCTURED = (
    "status:", "id:", "name:", "by:", "priority:", "started:", "completed:",
    "failed", "success", "running", "pending", ">", "<", ">=", "<=", "=",
)
SEMANTIC = (
    "like", "similar", "about", "related to", "concerning",
    "regarding", "find", "search for", "show me",
)
ROUTE_STRUCTURED = rf"(?i){W}[:=<>]|{whole('AND|OR')}"
ROUTE_SEMANTIC = ("like", "similar", "about", "related", "search", "find", "matching")
SHORT_QUERY_WORDS, SHORT_QUERY_WEIGHT = 3, 0.7
TARGETS = (
    r"how\s+many\s+(.*?)(?:\s+are|\s+with|\s+in|\s+is|\s+do|\?|$)",
    r"count\s+(?:of\s+)?(.*?)(?:\s+in|\s+with|\s+that|\?|$)",
    r"total\s+(?:number\s+of\s+)?(.*?)(?:\s+in|\s+with|\s+that|\?|$)",
    r"number\s+of\s+(.*?)(?:\s+in|\s+with|\s+that|\?|$)",
)
COMMON_ITEMS = (
    "item", "items", "record", "records", "entry", "entries",
    "document", "documents", "result", "results",
)
ID_PATTERNS = (
    r"(?:^|\s)id\s*[:=]?\s*(\d+)",
    r"(?:^|\s)item\s+id\s*[:=]?\s*(\d+)",
    r"(?:^|\s)#(\d+)",
)
LOOSE_ID_PATTERNS = (
    r"(?:^|\s)id\s*[:=]?\s*(\d+)",
    r"(?:^|\s)(?:item|job)\s+id\s*[:=]?\s*(\d+)",
    r"(?:^|\s)(?:item|job)[-_]id\s*[:=]?\s*(\d+)",
    r"(?:^|\s)#(\d+)",
    r"(?:^|\s)number\s*[:=]?\s*(\d+)",
    r"(?:^|\s)(\d{4,})\s*$",
)
# A name starts at a word edge and is taken whole, so long texts are read once.
NAME = rf"(?<!{W}){W}++"
FIELD_VALUE = rf'{NAME}[:=](?:"[^"]+"|\S+)'
COMPARISON = rf"{NAME}\s*(?:<=|>=|<|>|=|!=)\s*\d+(?:\.\d+)?"
TEMPORAL = f"(?i){LAST_SPAN}"
GROUP_BY = rf"(?i)group by\s+({W}+)"


def first_match(c: Column, patterns: Sequence[str], flags: str = "(?id)") -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(
        *[
            F.when(F.regexp_like(c, F.lit(flags + p)), F.regexp_extract(c, flags + p, 1))
            for p in patterns
        ]
    )


def has_any(c: Column, words: Iterable[str]) -> Column:
    return either(F.contains(c, F.lit(w)) for w in words)


def is_counting(q: Column, *, word_boundary: bool = False) -> Column:
    """Counting words count inside longer words too unless ``word_boundary``."""
    low = F.lower(q)
    if word_boundary:
        spaced = [w.replace(" ", r"\s+") for w in COUNTING]
        return F.regexp_like(low, F.lit(whole("|".join(spaced))))
    return has_any(low, COUNTING) | F.regexp_like(low, F.lit(whole("|".join(COUNTING_PATTERNS))))


def search_kind(q: Column, patterns: Sequence[str] = ()) -> Column:
    """hybrid, structured or semantic."""
    low = F.lower(q)
    by_word = has_any(low, STRUCTURED)
    by_form = either(F.regexp_like(q, F.lit(f"(?i){p}")) for p in patterns)
    has_structure, has_meaning = by_word | by_form, has_any(low, SEMANTIC)
    return (
        F.when(has_structure & has_meaning, "hybrid")
        .when(has_structure, "structured")
        .otherwise("semantic")
    )


def classify(q: Column, patterns: Sequence[str] = ()) -> Column:
    """counting, hybrid, structured or semantic."""
    return F.when(is_counting(q), "counting").otherwise(search_kind(q, patterns))


def route(q: Column) -> Column:
    """structured only where nothing asks for meaning, else hybrid."""
    meant = F.array(*[F.lit(w) for w in ROUTE_SEMANTIC])
    has_structure = F.regexp_like(q, F.lit(ROUTE_STRUCTURED))
    return F.when(has_structure & ~F.arrays_overlap(space_words(q), meant), "structured").otherwise(
        "hybrid"
    )


def vector_weight(q: Column, weight: float = 0.5) -> Column:
    """Short plain queries lean on the vector side; no state is kept."""
    short = F.size(space_words(q)) <= SHORT_QUERY_WORDS
    plain = ~F.regexp_like(q, F.lit(ROUTE_STRUCTURED))
    return F.when(plain & short, F.lit(max(weight, SHORT_QUERY_WEIGHT))).otherwise(F.lit(weight))


def count_target(q: Column) -> Column:
    """What is counted, else the first common item named, else ``items``."""
    low = F.lower(q)
    named = [F.when(F.contains(low, F.lit(w)), w) for w in COMMON_ITEMS]
    return F.coalesce(strip(first_match(low, TARGETS, "(?d)")), *named, F.lit("items"))


def id_in_query(q: Column, *, loose: bool = False) -> Column:
    """The id asked for, or null; ``loose`` adds job ids, numbers and long digits."""
    if loose:
        return first_match(q, LOOSE_ID_PATTERNS)
    either_way = rf"(?:{'|'.join(p.replace('(\\d+)', '\\d+') for p in ID_PATTERNS)})"
    return F.nullif(
        F.regexp_extract(F.regexp_extract(q, f"(?i){either_way}", 0), r"(\d+)$", 1), F.lit("")
    )


def group_by_field(q: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(q), GROUP_BY, 1), F.lit(""))


def strip_counting(q: Column) -> Column:
    """The search that remains once counting words, fillers and grouping go."""
    text = F.lower(q)
    for word in (*COUNTING, "?"):
        text = F.replace(text, F.lit(word), F.lit(""))
    text = F.regexp_replace(text, whole("|".join(FILLERS)), "")
    return strip(F.regexp_replace(text, GROUP_BY, ""))


def window_start(q: Column, as_of: Column) -> Column:
    """Start of the time span asked for, or null."""
    span = F.lower(F.when(F.contains(F.lower(q), F.lit("last")), F.regexp_extract(q, TEMPORAL, 0)))
    amount = F.regexp_extract(span, r"(\d+)", 1).try_cast("decimal(38,0)")
    days = F.coalesce(*[F.when(F.contains(span, F.lit(u)), F.lit(n)) for u, n in DAYS.items()])
    # A span that reaches back further than timestamps do begins with the first of them.
    reach = F.datediff(as_of.cast("date"), F.lit("0001-01-01").cast("date")).cast("long")
    back = F.when(days.isNotNull(), F.least(F.least(amount, reach).cast("long") * days, reach))
    return as_of - F.make_dt_interval(F.when(amount.isNotNull(), back).cast("int"))


def filters(q: Column, as_of: Column) -> Column:
    """Array of (field, op, value) strings: conditions, then the time span."""
    number = r"\d+(?:\.\d+)?"
    values = F.regexp_extract_all(q, F.lit(FIELD_VALUE), F.lit(0))
    rest = F.regexp_replace(q, FIELD_VALUE, " ")
    comparisons = F.regexp_extract_all(rest, F.lit(COMPARISON), F.lit(0))
    sign_names = F.create_map(*[F.lit(x) for pair in OPERATORS.items() for x in pair])

    def value_triple(m: Column) -> Column:
        is_number = F.regexp_like(m, F.lit(rf"^{W}+={number}$"))
        return F.struct(
            F.regexp_extract(m, rf"^({W}+)", 1).alias("field"),
            F.when(is_number, "eq").otherwise("is").alias("op"),
            F.trim(F.regexp_extract(m, r"(?s)^[^:=]+[:=](.*)$", 1), F.lit('"')).alias("value"),
        )

    def comparison_triple(m: Column) -> Column:
        return F.struct(
            F.regexp_extract(m, rf"^({W}+)", 1).alias("field"),
            F.element_at(sign_names, F.regexp_extract(m, r"([<>=!]+)", 1)).alias("op"),
            F.regexp_extract(m, rf"({number})$", 1).alias("value"),
        )

    start = window_start(q, as_of)
    span = F.array_compact(
        F.array(
            F.when(
                start.isNotNull(),
                F.struct(
                    F.lit("timestamp").alias("field"),
                    F.lit("gte").alias("op"),
                    F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("value"),
                ),
            )
        )
    )
    return F.concat(
        F.transform(values, value_triple), F.transform(comparisons, comparison_triple), span
    )
