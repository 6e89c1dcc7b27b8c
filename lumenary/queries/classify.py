"""Queries about tags, categories and pay benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary import dims
from lumenary.bindings import relations as R
from lumenary.bindings.ctes import listed, with_
from lumenary.bindings.relations import pick
from lumenary.dictionary import Dictionary
from lumenary.functions.phrases import experience
from lumenary.operators import classify as op
from lumenary.queries.register import query
from lumenary.queries.scoring import _LEVEL


def _any(text: str, words) -> str:
    return f"len(list_filter({listed(words)}, lambda w: contains({text}, w))) > 0"


_TAGS = f"""SELECT *, CASE WHEN remote AND home AND contains(first, 'ETHIOPIA') THEN 'ETHIOPIA_REMOTE' WHEN remote AND NOT home AND contains(first, 'LOCAL') THEN 'INTERNATIONAL_REMOTE' ELSE first END AS refined,
  list_sort(list_distinct(list_concat(default_tags, list_filter([CASE WHEN home THEN 'ethiopian' END, CASE WHEN remote THEN 'remote' END, CASE WHEN NOT home THEN 'international' END,
    CASE WHEN {_any('b', dims.NGO_WORDS)} THEN 'ngo' END, CASE WHEN {_any('t', dims.TECH_WORDS)} THEN 'tech' END, CASE WHEN {_any('t', dims.SENIOR_WORDS)} THEN 'senior' END,
    CASE WHEN {_any('t', dims.ENTRY_WORDS)} THEN 'entry_level' END, CASE WHEN {_any('b', dims.FREELANCE_WORDS)} THEN 'freelance' END], lambda x: x IS NOT NULL)))) AS tags
  FROM (SELECT *, CASE WHEN home AND location_class IN ('INTERNATIONAL_REMOTE', 'INTERNATIONAL_ONSITE') THEN CASE WHEN work_place = 'REMOTE' OR contains(lower(location), 'remote') THEN 'ETHIOPIA_REMOTE' ELSE 'ETHIOPIA_LOCAL' END ELSE location_class END AS first
    FROM (SELECT *, {_any('b', dims.HOME_WORDS)} AS home, {_any('b', dims.REMOTE_WORDS)} OR work_place = 'REMOTE' OR contains(lower(location), 'remote') AS remote
      FROM (SELECT job.*, default_tags, lower(location) || ' ' || lower(title) || ' ' || lower(company) AS b, lower(title) AS t FROM job JOIN source USING (source_id))))"""


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with the tags of their source and their own; ``given_class`` is the class that they came with."""
    sources = R.source(spark, sf).select("source_id", "default_tags", "default_location_class")
    return op.classify(R.job(spark, sf).withColumn("given_class", F.col("location_class")).join(sources, "source_id"))


@query("classify_jobs", with_("job", "source", more={"tagged": _TAGS}) + "SELECT job_id, refined AS location_class, array_to_string(tags, ',') AS tags FROM tagged")
def _classify(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).select("job_id", "location_class", F.array_join("tags", ",").alias("tags"))


@query(
    "tag_counts",
    with_("job", "source", more={"tagged": _TAGS})
    + f"""SELECT tag, count(x.job_id) AS n_jobs FROM (SELECT unnest({listed(dims.KNOWN_TAGS)}) AS tag) LEFT JOIN (SELECT job_id, unnest(tags) AS tag FROM tagged WHERE status = 'ACTIVE') x USING (tag) GROUP BY 1""",
)
def _tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Active postings of each known tag, those of none included."""
    known = dims.frame(spark, [(t,) for t in dims.KNOWN_TAGS], "tag string")
    counts = tagged(spark, sf).where("status = 'ACTIVE'").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_jobs"))
    return known.join(counts, "tag", "left").select("tag", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


_NORM = "trim(regexp_replace(lower(l), '[^a-z0-9\\s-]', '', 'g'))"
_TAX = [(c, i, "|".join(a), "|".join(k)) for i, (c, a, k) in enumerate(dims.TAXONOMY)]
_CAT = [(s, i, lab.lower(), "|".join(c)) for s, i, lab, c in dims.CATALOGUE]
_CATEGORIES = {
    "tax": f"SELECT * FROM {dims.values(_TAX, 'cat, ord, aliases, keywords')}",
    "catalogue": f"SELECT * FROM {dims.values(_CAT, 'src, cid, lab, cats')}",
    "lab": "SELECT job_id, source_id, unnest(labels) AS l, unnest(range(len(labels))) AS pos FROM job",
    "hits": f"""SELECT job_id, cat, min(prio) AS prio FROM (
      SELECT job_id, unnest(string_split(cats, '|')) AS cat, pos * 100 + unnest(range(len(string_split(cats, '|')))) AS prio FROM lab JOIN catalogue ON src = source_id AND {_NORM} IN (cid, lab)
      UNION ALL SELECT job_id, cat, 1000 + pos * 100 + ord FROM lab, tax WHERE len(list_filter(string_split(aliases, '|'), lambda a: contains({_NORM}, a) OR contains(a, {_NORM}))) > 0
      UNION ALL SELECT job_id, cat, 2000 + pos * 100 + ord FROM lab, tax WHERE len(list_filter(string_split(keywords, '|'), lambda k: contains(lower(l), k))) > 0
      UNION ALL SELECT job_id, cat, 3000 + ord FROM job, tax WHERE len(list_filter(string_split(keywords, '|'), lambda k: contains(lower(title || ' ' || array_to_string(skills, ' ')), k))) > 0) GROUP BY 1, 2""",
}


@query("map_categories", with_("job", more=_CATEGORIES) + "SELECT job_id, coalesce(string_agg(cat, ',' ORDER BY prio), '') AS categories FROM job LEFT JOIN hits USING (job_id) GROUP BY 1")
def _map(spark: SparkSession, sf: str) -> DataFrame:
    return R.job(spark, sf).select("job_id", F.array_join(op.map_categories(F.col("source_id"), F.col("labels"), F.col("title"), F.col("skills")), ",").alias("categories"))


@query("category_counts", with_("job", more=_CATEGORIES) + "SELECT coalesce(cat, 'unmapped') AS category, count(*) AS n_jobs FROM job LEFT JOIN hits USING (job_id) GROUP BY 1")
def _category_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of each category, and of none."""
    cats = R.job(spark, sf).select(F.explode_outer(op.map_categories(F.col("source_id"), F.col("labels"), F.col("title"), F.col("skills"))).alias("category"))
    return cats.groupBy(F.coalesce("category", F.lit("unmapped")).alias("category")).agg(F.count("*").alias("n_jobs"))


@query(
    "label_validity",
    with_("job", more={k: _CATEGORIES[k] for k in ("catalogue", "lab")})
    + "SELECT source_id, count(*) AS n_labels, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM catalogue WHERE src = source_id AND cid = lower(l))) AS n_valid FROM (SELECT DISTINCT job_id, source_id, lower(l) AS l FROM lab) GROUP BY 1",
)
def _valid(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that a source's catalogue has, against all."""
    low = F.array_distinct(F.transform("labels", lambda x: F.lower(x)))
    rows = R.job(spark, sf).select("source_id", F.size(low).alias("n"), F.size(op.valid_labels(F.col("source_id"), low)).alias("v"))
    return rows.groupBy("source_id").agg(F.sum("n").alias("n_labels"), F.sum("v").alias("n_valid"))


_ROLES = [(a, i, r) for i, (a, r) in enumerate(dims.SALARY_ROLES)]
_BENCH = [(i, *r) for i, r in enumerate(dims.SALARIES)]
_PAY = {
    "roles": f"SELECT * FROM {dims.values(_ROLES, 'alias, ord, role')}",
    "bench": f"SELECT * FROM {dims.values(_BENCH, 'n, role, level, ll, lm, lh, fl, fm, fh')}",
    "j": f"SELECT *, CASE {_LEVEL} WHEN 'INTERN' THEN 'ENTRY' ELSE {_LEVEL} END AS want, CASE WHEN salary <> 0 THEN salary END AS pay, (SELECT arg_min(role, ord) FROM roles WHERE contains(lower(title), alias)) AS role FROM job",
}


@query(
    "salary_benchmark",
    with_(
        "job",
        more={
            **_PAY,
            "p": "SELECT j.job_id, j.pay, j.currency, arg_min(b, CASE WHEN b.level = want THEN n ELSE 100 + n END) AS b FROM j LEFT JOIN bench b ON b.role = j.role GROUP BY ALL",
            "q": "SELECT *, CASE WHEN currency = 'ETB' THEN b.ll ELSE b.fl END AS lo, CASE WHEN currency = 'ETB' THEN b.lm ELSE b.fm END AS mid, CASE WHEN currency = 'ETB' THEN b.lh ELSE b.fh END AS hi FROM p",
            "r": "SELECT *, CASE WHEN pay IS NOT NULL AND b.role IS NOT NULL THEN CAST(least(100, greatest(0, floor((pay - lo) / CAST(hi - lo AS DOUBLE) * 100 + 0.5))) AS BIGINT) END AS percentile FROM q",
        },
    )
    + """SELECT job_id, b.role AS role, b.level AS level, percentile, CASE WHEN percentile IS NOT NULL THEN CAST(floor((pay - mid) / CAST(mid AS DOUBLE) * 100 + 0.5) AS BIGINT) END AS percent_above,
    CASE WHEN percentile >= 80 THEN 'above market' WHEN percentile >= 50 THEN 'at market' WHEN percentile >= 20 THEN 'below median' WHEN percentile >= 0 THEN 'well below market' END AS comparison FROM r""",
)
def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    pay = F.nullif("salary", F.lit(0))
    jobs = R.job(spark, sf).withColumn("b", op.benchmark(F.col("title"), experience(F.col("title"))))
    return jobs.select("job_id", "b.role", "b.level", *(c.alias(n) for n, c in op.compare_pay(pay, F.coalesce("currency", F.lit("")), F.col("b")).items()))


def loaded(spark: SparkSession, sf: str) -> Dictionary:
    """A dictionary out of the tables: a node for each type of part, below one for its first two words, and a pay range for each type and level."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    kind, above = F.lower("p_type"), F.substring_index(F.lower("p_type"), " ", 2)
    leaves = part.select(F.translate(kind, " ", ".").alias("category"), F.translate(above, " ", ".").alias("parent"), F.array(F.substring_index(kind, " ", -1)).alias("aliases"), F.array(kind).alias("keywords")).distinct()
    nodes = part.select(F.translate(above, " ", ".").alias("category"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("aliases"), F.array(above).alias("keywords")).distinct()
    place = F.row_number().over(Window.orderBy(F.col("category"))) - 1
    labels = R.job(spark, sf).select(F.col("source_id").alias("source"), F.col("labels")[0].alias("label")).distinct()
    catalogue = labels.select((F.row_number().over(Window.orderBy("source", "label")) - 1).alias("ord"), "source", F.concat(F.lit("id-"), F.lower("label")).alias("id"), "label", F.array(F.concat(F.lit("label."), F.col("label"))).alias("categories"))
    roles = part.select(kind.alias("phrase"), F.col("p_type").alias("role")).distinct()
    pay = part.groupBy(F.col("p_type").alias("role"), pick(("ENTRY", "MID", "SENIOR"), F.col("p_size")).alias("level")).agg(F.floor(F.min("p_retailprice")).alias("low"), F.floor(F.max("p_retailprice")).alias("high"))
    mid = F.floor((F.col("low") + F.col("high")) / 2)
    amounts = [F.col("low").alias("local_low"), mid.alias("local_mid"), F.col("high").alias("local_high"), F.col("low").alias("foreign_low"), mid.alias("foreign_mid"), F.col("high").alias("foreign_high")]
    return Dictionary.of(
        {
            "taxonomy": leaves.union(nodes).withColumn("ord", place),
            "catalogue": catalogue,
            "pay_roles": roles.withColumn("ord", F.row_number().over(Window.orderBy("phrase")) - 1),
            "pay": pay.select((F.row_number().over(Window.orderBy("role", "level")) - 1).alias("ord"), "role", "level", *amounts),
        }
    )


_ABOVE = "array_to_string(string_split(lower(p_type), ' ')[1:2], ' ')"
_LOADED = {
    "nodes": f"""SELECT *, row_number() OVER (ORDER BY cat) AS ord FROM (SELECT DISTINCT replace(lower(p_type), ' ', '.') AS cat, string_split(lower(p_type), ' ')[-1] AS alias, lower(p_type) AS keyword FROM part
      UNION ALL SELECT DISTINCT replace({_ABOVE}, ' ', '.'), NULL, {_ABOVE} FROM part)""",
    "lab": "SELECT job_id, source_id, unnest(labels) AS l, unnest(range(len(labels))) AS pos FROM job",
    "hits": f"""SELECT job_id, cat, min(prio) AS prio FROM (
      SELECT job_id, 'label.' || k.l AS cat, pos * 100000 AS prio FROM lab JOIN (SELECT DISTINCT source_id, labels[1] AS l FROM job) k ON k.source_id = lab.source_id AND trim(regexp_replace(lower(k.l), '[^a-z0-9\\s-]', '', 'g')) = {_NORM.replace('lower(l)', 'lower(lab.l)')}
      UNION ALL SELECT job_id, cat, 1000000 + pos * 100000 + ord FROM lab JOIN nodes ON contains({_NORM}, alias) OR contains(alias, {_NORM})
      UNION ALL SELECT job_id, cat, 2000000 + pos * 100000 + ord FROM lab JOIN nodes ON contains(lower(l), keyword)
      UNION ALL SELECT job_id, cat, 3000000 + ord FROM job JOIN nodes ON contains(lower(title || ' ' || array_to_string(skills, ' ')), keyword)) GROUP BY 1, 2""",
}


@query("map_categories_loaded", with_("job", more=_LOADED) + "SELECT job_id, coalesce(string_agg(cat, ',' ORDER BY prio), '') AS categories FROM job LEFT JOIN hits USING (job_id) GROUP BY 1")
def _map_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Categories by a dictionary that is loaded from tables."""
    found = op.map_categories(F.col("source_id"), F.col("labels"), F.col("title"), F.col("skills"), loaded(spark, sf))
    return R.job(spark, sf).select("job_id", F.array_join(found, ",").alias("categories"))


@query(
    "salary_benchmark_loaded",
    with_(
        "job",
        more={
            "pay": "SELECT p_type AS role, ['ENTRY', 'MID', 'SENIOR'][CAST(p_size % 3 AS BIGINT) + 1] AS level, CAST(floor(min(p_retailprice)) AS BIGINT) AS low, CAST(floor(max(p_retailprice)) AS BIGINT) AS high FROM part GROUP BY 1, 2",
            "b": "SELECT *, row_number() OVER (ORDER BY role, level) AS n FROM pay",
            "j": f"SELECT job_id, CASE {_LEVEL} WHEN 'INTERN' THEN 'ENTRY' ELSE {_LEVEL} END AS want, (SELECT arg_min(p_type, lower(p_type)) FROM part WHERE contains(lower(title), lower(p_type))) AS role FROM job",
        },
    )
    + "SELECT job_id, b.role AS role, arg_min(b.level, CASE WHEN b.level = want THEN n ELSE 100000 + n END) AS level, arg_min((b.low + b.high) // 2, CASE WHEN b.level = want THEN n ELSE 100000 + n END) AS mid FROM j LEFT JOIN b ON b.role = j.role GROUP BY 1, 2",
)
def _benchmark_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Pay ranges by a dictionary that is loaded from tables."""
    jobs = R.job(spark, sf).select("job_id", op.benchmark(F.col("title"), experience(F.col("title")), loaded(spark, sf)).alias("b"))
    return jobs.select("job_id", "b.role", "b.level", F.col("b.local_mid").alias("mid"))
