"""Tables, quasi-identifier sets and SQL fragments shared by the queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quasirisk.plans.keys import col

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round doubles for comparison; the last bits depend on summation order."""
    return df.select(*[
        (F.round(col(c), digits) + F.lit(0.0)).alias(c) if c in columns else col(c) for c in df.columns
    ])


# -- source tables -----------------------------------------------------------------

CUSTOMER_QI = ["n_name", "c_mktsegment", "balance_band"]
CUSTOMER_SQL = """
  SELECT c_custkey, n_name, c_mktsegment, CAST(floor(c_acctbal / 1000) AS BIGINT) AS balance_band,
         CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS balance_sign
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "c_custkey", "n_name", "c_mktsegment",
        F.floor(F.col("c_acctbal") / 1000).cast("long").alias("balance_band"),
        F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("balance_sign"),
    )


PART_QI = ["p_brand", "p_type", "p_size"]
PART_SQL = "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *PART_QI, "p_retailprice")


ORDER_QI = ["o_orderstatus", "o_orderpriority", "order_year", "order_month"]
ORDER_SQL = """
  SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS order_year,
         CAST(month(o_orderdate) AS INTEGER) AS order_month, o_totalprice FROM orders"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("order_month"), "o_totalprice",
    )


LINE_QI = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_SQL = "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_QI)


DOC_QI = ["lang", "source", "quality", "toxic"]
DOC_SQL = """
  SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", *DOC_QI, "n_chars")


# -- SQL generators ----------------------------------------------------------------


def subsets(qi: Sequence[str], low: int, high: int) -> list[tuple[int, ...]]:
    return [s for size in range(low, high + 1) for s in combinations(range(len(qi)), size)]


def mask_of(members: Sequence[int]) -> int:
    return sum(1 << i for i in members)


def uniques_sql(qi: Sequence[str], members: Sequence[int], drop_nulls: bool, source: str = "t") -> str:
    """Scalar subquery: combinations of the member columns held by exactly one row."""
    if not members:
        return "0"
    names = ", ".join(f'"{qi[i]}"' for i in members)
    where = " WHERE " + " AND ".join(f'"{qi[i]}" IS NOT NULL' for i in members) if drop_nulls else ""
    return f"(SELECT count(*) FROM (SELECT 1 FROM {source}{where} GROUP BY {names} HAVING count(*) = 1))"


def gains_sql(source: str, qi: Sequence[str], masked: Sequence[str] = (), mask: str = "{c} IS NULL") -> str:
    """CTEs ending in ``gains``: QIs, n, cig_<c>.., RIG; from the definition with windows."""
    share, bits, cell = [], [], []
    for i, c in enumerate(qi):
        others = ", ".join(f'"{o}"' for o in qi if o != c)
        share.append(f'n / sum(n) OVER (PARTITION BY {others}) AS p{i}')
        share.append(f'sum(n) OVER (PARTITION BY "{c}") / sum(n) OVER () AS q{i}')
        bits.append(f"sum(p{i} * log2(p{i} / q{i})) OVER (PARTITION BY {others}) AS g{i}")
        hit = "CASE WHEN " + mask.format(c=f'"{c}"') + " THEN 0.0 ELSE {g} END" if c in masked else "{g}"
        cell.append(hit.format(g=f"greatest(g{i}, 0.0)") + f' AS "cig_{c}"')
    names = ", ".join(f'"{c}"' for c in qi)
    return f"""t AS ({source}),
  base AS (SELECT {names}, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
  shares AS (SELECT *, {", ".join(share)} FROM base),
  bits AS (SELECT *, {", ".join(bits)} FROM shares),
  cells AS (SELECT {names}, n, {", ".join(cell)} FROM bits),
  gains AS (SELECT *, {" + ".join(f'"cig_{c}"' for c in qi)} AS "RIG" FROM cells)"""


def same_tuple(qi: Sequence[str], a: str = "t", b: str = "gains") -> str:
    return " AND ".join(f'{a}."{c}" IS NOT DISTINCT FROM {b}."{c}"' for c in qi)


def msu_sql(source: str, row_id: str, qi: Sequence[str], high: int | None = None, missing_nulls: bool = False) -> str:
    """CTEs t, msu(id, mask, size, weight), scored(id, n_msu, score)."""
    m = len(qi)
    top = high or m
    level = []
    for members in subsets(qi, 1, top):
        names = ", ".join(f'"{qi[i]}"' for i in members)
        where = " WHERE " + " AND ".join(f'"{qi[i]}" IS NOT NULL' for i in members) if missing_nulls else ""
        level.append(f"SELECT id, {mask_of(members)} AS mask, count(*) OVER (PARTITION BY {names}) AS n FROM t{where}")
    cases = []
    for size in range(1, top + 1):
        weight = 1
        for i in range(size, top):
            weight *= m - i
        cases.append(f"WHEN {size} THEN {weight}.0")
    return f"""t AS (SELECT {row_id} AS id, * FROM ({source})),
  single AS (SELECT id, mask FROM ({" UNION ALL ".join(level)}) WHERE n = 1),
  minimal AS (SELECT id, mask FROM single s WHERE NOT EXISTS (
    SELECT 1 FROM single v WHERE v.id = s.id AND v.mask <> s.mask AND (s.mask & v.mask) = v.mask)),
  msu AS (SELECT id, mask, bit_count(mask) AS size,
    (CASE bit_count(mask) {" ".join(cases)} END)::DOUBLE AS weight FROM minimal),
  scored AS (SELECT id, count(*) AS n_msu, sum(weight) AS score FROM msu GROUP BY id)"""


def dis_sql(qi: Sequence[str], fraction: float) -> str:
    """CTE ``level``(ones, twos, theta)."""
    names = ", ".join(f'"{c}"' for c in qi)
    p = repr(float(fraction))
    return f"""sizes AS (SELECT count(*) AS n FROM t GROUP BY {names}),
  counted AS (SELECT count(*) FILTER (n = 1) AS ones, count(*) FILTER (n = 2) AS twos FROM sizes),
  level AS (SELECT ones, twos, {p} * ones / ({p} * ones + 2.0 * (1.0 - {p}) * twos) AS theta FROM counted)"""


def mad_sql(source: str, value: str, row_id: str) -> str:
    """CTEs v(id, x), scale: the series to test with its quartiles and MAD (zero fallback)."""
    return f"""v AS (SELECT {row_id} AS id, {value}::DOUBLE AS x FROM ({source}) WHERE {value} IS NOT NULL),
  series AS (SELECT 0 AS series, x FROM v UNION ALL SELECT 1, x FROM v WHERE x <> 0),
  mid AS (SELECT series, count(*) AS n_rows, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
    quantile_cont(x, 0.75) AS q3 FROM series GROUP BY series),
  spread AS (SELECT m.series, any_value(n_rows) AS n_rows, any_value(q1) AS q1, any_value(med) AS med, any_value(q3) AS q3,
    quantile_cont(abs(x - med), 0.5) AS mad FROM series s JOIN mid m ON s.series = m.series GROUP BY m.series),
  scale AS (SELECT a.* FROM spread a, (SELECT max(CASE WHEN series = 0 THEN mad END) AS mad0,
      max(CASE WHEN series = 0 THEN n_rows END) AS rows0 FROM spread) f
    WHERE rows0 >= 5 AND ((series = 0 AND mad0 > 0) OR (series = 1 AND mad0 = 0 AND n_rows >= 5 AND mad > 0))),
  scored_x AS (SELECT id, x, (x - med) / (mad / 0.6745) AS z FROM v, scale WHERE series = 0 OR x <> 0)"""
