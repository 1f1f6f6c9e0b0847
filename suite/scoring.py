"""Relevance and ranking."""

from pyspark.sql import functions as F

from siftwell.functions import scores
from siftwell.operators import search as S
from siftwell.plans.ask import ask
from siftwell.roles import Roles, to_standard
from suite.registry import case

PART = Roles(id="p_partkey", name="p_name", status="p_type")
TEXTS = ("p_name", "p_brand", "p_type")


def sql_points(column: str, query: str, blank: str = r"\s+") -> str:
    words = "[" + ", ".join(f"'{w}'" for w in sorted(set(query.lower().split()))) + "]"
    q = query.lower()
    return f"""(CASE WHEN {column} IS NULL OR {column} = '' THEN 0.0::DOUBLE
        WHEN lower({column}) = '{q}' THEN 10.0::DOUBLE
        WHEN contains(lower({column}), '{q}') THEN 5.0::DOUBLE
        WHEN list_has_any(regexp_split_to_array(lower({column}), '{blank}'), {words}) THEN 1.0::DOUBLE
        ELSE 0.0::DOUBLE END)"""


def sql_part_score(query: str, name: float = 3, type_: float = 2, brand: float = 1) -> str:
    return (
        f"({sql_points('p_name', query)} * {name} + {sql_points('p_brand', query)} * {brand}"
        f" + {sql_points('p_type', query)} * {type_})::DOUBLE"
    )


@case(f"""SELECT p_partkey, p_name, {sql_part_score('red widget')} AS score, 'text' AS kind
          FROM part WHERE {sql_part_score('red widget')} > 0""")
def score_text(t):
    found = S.text_search(t.part, "Red Widget", PART, fields=TEXTS)
    return found.select("p_partkey", "p_name", F.col("_score").alias("score"), F.col("_match_type").alias("kind"))


#: Every column of ``part`` with its weight by role.
ALL = {"p_partkey": 1, "p_name": 3, "p_brand": 1, "p_type": 2, "p_size": 1, "p_retailprice": 1}


def sql_all_points(query: str) -> dict[str, str]:
    return {c: sql_points(f"{c}::VARCHAR", query) for c in ALL}


def sql_all_score(query: str) -> str:
    return "(" + " + ".join(f"{p} * {ALL[c]}" for c, p in sql_all_points(query).items()) + ")::DOUBLE"


@case(f"SELECT p_partkey, {sql_all_score('widget 24')} AS score FROM part WHERE {sql_all_score('widget 24')} > 0")
def score_all_columns(t):
    """Numbers are searched too: 24 is a size, a key or a word of a name."""
    found = S.text_search(t.part, "Widget 24", PART)
    return found.select("p_partkey", F.col("_score").alias("score"))


@case(f"""SELECT p_partkey, concat_ws(',', {', '.join(f"CASE WHEN {p} > 0 THEN '{c}' END" for c, p in sql_all_points('24').items())}) AS fields
  FROM part""")
def matched_all_columns(t):
    parts = t.part
    return parts.select("p_partkey", F.array_join(scores.matched_fields(parts, "24"), ",").alias("fields"))


@case(f"""SELECT p_partkey, {sql_all_score('24')} AS score FROM part WHERE {sql_all_score('24')} > 0
  ORDER BY score DESC, p_partkey LIMIT 50""")
def top_k_all_columns(t):
    found = S.best_matches(t.part, "24", PART, 50)
    return found.select("p_partkey", F.col("_score").alias("score"))


@case("""SELECT c_custkey, contains(c_custkey::VARCHAR, '12')::INT + contains(c_name, '12')::INT
           + contains(c_nationkey::VARCHAR, '12')::INT + contains(c_acctbal::VARCHAR, '12')::INT
           + contains(c_mktsegment, '12')::INT AS hits FROM customer""")
def score_hits(t):
    customers = t.customer
    return customers.select("c_custkey", scores.hit_count(customers, "12").alias("hits"))


def _keyword(column: str, word: str) -> str:
    return f"""(CASE WHEN lower({column}) = '{word}' THEN 2.0::DOUBLE
        WHEN contains(lower({column}), '{word}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)"""


@case(f"""SELECT p_partkey AS id, 1.0::DOUBLE + {' + '.join(_keyword(c, w) for c in TEXTS for w in ('small', 'widget'))}
            + (CASE WHEN contains(lower(p_name), 'small widget') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
          FROM part WHERE p_size > 40 AND (
            {' OR '.join(f"contains(lower({c}), '{w}')" for c in TEXTS for w in ('small', 'widget'))})""")
def score_structured(t):
    parts = to_standard(t.part, PART)
    found = S.relevance_search(parts, "p_size>40 small widget", ["id", "name", "p_brand", "status"])
    return found.select("id", F.col("_score").alias("score"))


@case(f"""SELECT p_partkey AS id, 1.0::DOUBLE + {' + '.join(_keyword(f'{c}::VARCHAR', w) for c in ALL for w in ('small', '950'))}
            + (CASE WHEN contains(lower(p_name), 'small 950') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
          FROM part WHERE p_size > 40 AND (
            {' OR '.join(f"contains(lower({c}), '{w}')" for c in TEXTS for w in ('small', '950'))})""")
def score_structured_all_columns(t):
    """Words choose rows by the text columns and score all columns, numbers too."""
    found = S.relevance_search(to_standard(t.part, PART), "p_size>40 small 950")
    return found.select("id", F.col("_score").alias("score"))


@case("""SELECT o_orderkey, 1.0::DOUBLE AS score, 'structured' AS kind,
           'o_orderstatus=F; o_totalprice>=300000' AS conditions
         FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 300000""")
def score_conditions(t):
    found = S.structured_search(t.orders, "o_orderstatus:F o_totalprice>=300000")
    return found.select(
        "o_orderkey",
        F.col("_score").alias("score"),
        F.col("_match_type").alias("kind"),
        F.array_join("_conditions", "; ").alias("conditions"),
    )


@case(f"""SELECT p_partkey, concat_ws(',', CASE WHEN {sql_points('p_name', 'small')} > 0 THEN 'p_name' END,
            CASE WHEN {sql_points('p_brand', 'small')} > 0 THEN 'p_brand' END,
            CASE WHEN {sql_points('p_type', 'small')} > 0 THEN 'p_type' END) AS matched
          FROM part WHERE {sql_part_score('small')} > 0""")
def matched_fields(t):
    found = S.text_search(t.part, "small", PART, fields=TEXTS)
    return found.select("p_partkey", F.array_join("_matched_fields", ",").alias("matched"))


@case(f"""SELECT p_partkey, {sql_part_score('large', 2.0, 1.5, 0.5)} AS score
          FROM part WHERE {sql_part_score('large', 2.0, 1.5, 0.5)} > 0""")
def score_weights(t):
    weights = {"p_name": 2.0, "p_type": 1.5, "default": 0.5}
    found = S.text_search(t.part, "large", weights=weights, fields=TEXTS)
    return found.select("p_partkey", F.col("_score").alias("score"))


@case(f"""SELECT id, name, score FROM (
            SELECT c_custkey AS id, c_name AS name,
                   {sql_points('c_name', '000000012')} * 3 + {sql_points('c_mktsegment', '000000012')} * 2 AS score
            FROM customer
            UNION ALL SELECT s_suppkey, s_name, {sql_points('s_name', '000000012')} * 3 FROM supplier)
          WHERE score > 0 ORDER BY score DESC, id, name LIMIT 15""")
def merge_sources(t):
    customer = Roles(id="c_custkey", name="c_name", status="c_mktsegment")
    supplier = Roles(id="s_suppkey", name="s_name")
    found = [
        to_standard(S.text_search(df, "000000012", roles, fields=fields), roles)
        for df, roles, fields in (
            (t.customer, customer, ["c_name", "c_mktsegment"]),
            (t.supplier, supplier, ["s_name"]),
        )
    ]
    return S.merge_sources(found, 15, ("id", "name")).select("id", "name", F.col("_score").alias("score"))


@case(f"""SELECT p_partkey, p_name, {sql_part_score('old gear')} AS score FROM part
          WHERE {sql_part_score('old gear')} > 0 ORDER BY score DESC, p_partkey LIMIT 20""")
def top_k(t):
    found = S.search(t.part, "old gear", PART, 20, TEXTS)
    return found.select("p_partkey", "p_name", F.col("_score").alias("score"))


@case(f"""SELECT p_partkey, p_name, {sql_part_score('blue')} AS score FROM part
          WHERE {sql_part_score('blue')} >= 5 ORDER BY p_retailprice, p_partkey LIMIT 25""")
def result_settings(t):
    found = S.text_search(t.part, "blue", PART, fields=TEXTS)
    settings = {
        "min_score": 5, "max_results": 25, "sort_by": "p_retailprice", "sort_order": "asc",
        "exclude_fields": ("p_size", "p_retailprice", "p_brand", "p_type", "_match_type", "_matched_fields"),
    }
    return S.with_settings(found, "p_partkey", settings).withColumnRenamed("_score", "score")


@case("""SELECT p_partkey, p_name, 1.0::DOUBLE AS score, 'exact_id' AS kind
         FROM part WHERE p_partkey = 17""")
def id_first(t):
    found = S.id_first(t.part, 17, "widget", PART, fields=TEXTS)
    return found.select("p_partkey", "p_name", F.col("_score").alias("score"), F.col("_match_type").alias("kind"))


@case(f"""SELECT p_partkey, p_name, {sql_part_score('new ring')} AS score, 'text' AS kind FROM part
          WHERE {sql_part_score('new ring')} > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def id_first_miss(t):
    found = S.id_first(t.part, 999999999, "new ring", PART, fields=TEXTS)
    return found.select("p_partkey", "p_name", F.col("_score").alias("score"), F.col("_match_type").alias("kind"))


@case(f"""SELECT p_partkey, p_name, {sql_part_score('hot plate')} AS score FROM part
          WHERE {sql_part_score('hot plate')} > 0 ORDER BY score DESC, p_partkey LIMIT 10""")
def ask_search(t):
    found = ask(t.part, "hot plate", PART, fields=TEXTS)
    return found.select("p_partkey", "p_name", F.col("_score").alias("score"))


@case("SELECT p_partkey, p_name, 'exact_id' AS kind FROM part WHERE p_partkey = 42")
def ask_id(t):
    found = ask(t.part, "show item id 42", PART, fields=TEXTS)
    return found.select("p_partkey", "p_name", F.col("_match_type").alias("kind"))


@case("SELECT count(*) AS count FROM part WHERE p_size > 30 AND lower(p_type) = 'promo'")
def ask_count(t):
    return ask(t.part, "how many parts have p_size>30 and p_type:promo?", PART).select("count")
