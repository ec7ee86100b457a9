"""Pairs, texts and measurements derived from the given star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = "2004-01-01"

SKILL = T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("proficiency", T.StringType())])
EXPERIENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("company", "position")]
    + [T.StructField(n, T.DateType()) for n in ("start_date", "end_date")]
    + [T.StructField("description", T.StringType()), T.StructField("achievements", T.ArrayType(T.StringType()))]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _noun(name: Column) -> Column:
    return F.element_at(F.split(name, " "), 2)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each market segment: its four most ordered nouns are the skills it requires.

    (segment, required_skills, preferred_skills, years_experience). Counts are partial sums, so the shuffle is of a few
    rows for each task; the result has one row a segment.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    parts = table(spark, sf_dir, "part").select("p_partkey", _noun(F.col("p_name")).alias("noun"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    counts = joined.groupBy("segment", "noun").count()
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "noun"))), lambda x: x["noun"])
    return counts.groupBy("segment").agg(ranked.alias("nouns")).select("segment", F.slice("nouns", 1, 4).alias("required_skills"), F.slice("nouns", 5, 2).alias("preferred_skills"), (F.length("segment") % 7).alias("years_experience"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resume and job pair for every order: lines are jobs held and skills, the segment gives the job.

    Columns: seq, trace_id, fit_level, job_id, resume and job_description in the nested shape of a pair record.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    level = F.when(F.col("l_quantity") < 13, "beginner").when(F.col("l_quantity") < 26, "intermediate").when(F.col("l_quantity") < 39, "advanced").otherwise("expert")
    title = F.when((F.col("l_linenumber") == 7) & (F.col("l_discount") >= 0.1), "Director of Sales").when(F.col("l_tax") >= 0.07, "Senior Engineer").when(F.col("l_returnflag") == "R", "Associate").otherwise("Analyst")
    start = F.to_date("l_shipdate")
    end = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)), F.date_add(start, (F.col("l_quantity") * 30).cast("int")))
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey",
        F.struct(F.concat_ws(" ", F.initcap(_noun(F.col("p_name"))), F.col("p_size")).alias("name"), F.lit("General").alias("category"), level.alias("proficiency")).alias("skill"),
        F.struct(F.lit("Northstar").alias("company"), title.alias("position"), start.alias("start_date"), end.alias("end_date"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("description"), F.array(F.concat(F.lit("Delivered "), F.lower("p_type"))).alias("achievements")).alias("experience"),
    )
    # an order has at most a few dozen lines, so its list is small
    held = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fit = F.when(F.col("o_custkey") % 11 == 0, None).otherwise(F.get(F.array(*(F.lit(x) for x in ("excellent", "good", "partial", "poor", "complete_mismatch"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1))
    seniority = F.when(F.col("o_orderstatus") == "O", "entry_level").when(F.col("o_orderstatus") == "F", "mid_level").otherwise("senior")
    joined = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(F.broadcast(jobs(spark, sf_dir)), F.col("c_mktsegment") == F.col("segment"))  # one row a segment
    lines_ = F.coalesce(F.col("lines"), F.from_json(F.lit("[]"), T.ArrayType(T.StructType([T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()), T.StructField("skill", SKILL), T.StructField("experience", EXPERIENCE)]))))
    resume = F.struct(
        F.struct(F.col("c_name").alias("name"), F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email")).alias("contact_info"),
        F.transform(lines_, lambda x: x["experience"]).alias("experience"),
        F.transform(lines_, lambda x: x["skill"]).alias("skills"),
        F.struct(F.concat(F.lit("template_"), F.col("o_custkey") % 5).alias("prompt_template")).alias("metadata"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Passionate about scalable "), F.lower("c_mktsegment"), F.lit(" and robust, dynamic, seamless synergy work"))).alias("summary"),
    )
    job = F.struct(
        F.col("segment").alias("industry"), F.concat_ws(" ", F.initcap("segment"), F.lit("Engineer")).alias("position"),
        F.struct("required_skills", "preferred_skills", seniority.alias("experience_level"), "years_experience").alias("requirements"),
        F.struct((F.col("c_nationkey") % 5 == 0).alias("is_niche_role")).alias("metadata"),
    )
    return joined.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("pair-"), F.col("o_orderkey")).alias("trace_id"), fit.alias("fit_level"), F.concat_ws("-", "segment", F.col("o_custkey") % 50).alias("job_id"), resume.alias("resume"), job.alias("job_description"))


#: The same pairs for DuckDB, flat: p has one row a pair, lists in the order of the lines.
PAIRS_SQL = """
nouns AS (SELECT c_mktsegment AS segment, split_part(p_name, ' ', 2) AS noun, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
jobs AS (SELECT segment, list(noun ORDER BY n DESC, noun) AS nouns FROM nouns GROUP BY segment),
held AS (SELECT l_orderkey,
  list(upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) || ' ' || p_size ORDER BY l_linenumber, l_partkey, l_suppkey) AS skills,
  list(CASE WHEN l_quantity < 13 THEN 'beginner' WHEN l_quantity < 26 THEN 'intermediate' WHEN l_quantity < 39 THEN 'advanced' ELSE 'expert' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS levels,
  list(CASE WHEN l_linenumber = 7 AND l_discount >= 0.1::DOUBLE THEN 'Director of Sales' WHEN l_tax >= 0.07::DOUBLE THEN 'Senior Engineer' WHEN l_returnflag = 'R' THEN 'Associate' ELSE 'Analyst' END ORDER BY l_linenumber, l_partkey, l_suppkey) AS titles,
  list(p_name || ' ' || p_type || ' ' || p_name || chr(10) || 'Delivered ' || lower(p_type) ORDER BY l_linenumber, l_partkey, l_suppkey) AS stories,
  sum(greatest(0::DOUBLE, (CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN date_diff('day', l_shipdate::DATE, DATE '2004-01-01') ELSE (l_quantity * 30)::INT END) / 365.25::DOUBLE)) AS years
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
p AS (SELECT o_orderkey AS seq, 'pair-' || o_orderkey AS trace_id, o_custkey AS custkey, c_mktsegment || '-' || (o_custkey % 50) AS job_id, c_mktsegment AS industry,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE ['excellent', 'good', 'partial', 'poor', 'complete_mismatch'][o_orderpriority[1]::INT] END AS fit_level,
  CASE o_orderstatus WHEN 'O' THEN 'entry_level' WHEN 'F' THEN 'mid_level' ELSE 'senior' END AS seniority,
  'template_' || (o_custkey % 5) AS template, c_nationkey % 5 = 0 AS is_niche, nouns[1:4] AS required, nouns[5:6] AS preferred, length(c_mktsegment) % 7 AS required_years,
  coalesce(skills, []) AS skills, coalesce(levels, []) AS levels, coalesce(titles, []) AS titles, coalesce(stories, []) AS stories, coalesce(years, 0)::DOUBLE AS years,
  CASE WHEN o_custkey % 3 = 0 THEN 'Passionate about scalable ' || lower(c_mktsegment) || ' and robust, dynamic, seamless synergy work' END AS summary
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN jobs ON segment = c_mktsegment LEFT JOIN held ON l_orderkey = o_orderkey)"""
