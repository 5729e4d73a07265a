"""Candidates and vacancies derived from the star-schema tables: every order is a vacancy, every supplier a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions.text import job_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt over all cores: a table of short rows is a small file, and a file of one row group one task, whatever each row costs afterwards."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("l_linenumber").isin(1, 2), "skills").when(F.col("l_linenumber") == 3, "protocols").when(F.col("l_linenumber") == 4, "standards").when(F.col("l_linenumber") == 5, "domains").otherwise("languages")
    name = (
        F.when(F.col("l_linenumber").isin(1, 2), F.col("p_name")).when(F.col("l_linenumber") == 3, F.lower("p_type")).when(F.col("l_linenumber") == 4, F.lower("p_brand"))
        .when(F.col("l_linenumber") == 5, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.concat(F.lit("lang_"), (F.col("p_size") % 6).cast("string")))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("*", bucket.alias("bucket"), name.alias("name"), F.col("l_linenumber").alias("pos"))


def job_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_key, bucket, name, pos, requirement_level, confidence)."""
    level = F.when(F.col("l_returnflag") == "R", "required").when(F.col("l_returnflag") == "A", "preferred")
    return _items(spark, sf_dir).select(F.col("l_orderkey").alias("job_key"), "bucket", "name", "pos", level.alias("requirement_level"), F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"))


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cand_key, bucket, name, n, strength, confidence)."""
    strength = F.when(F.col("n") >= 12, "core").when(F.col("n") >= 6, "strong").when(F.col("n") >= 3, "secondary").otherwise("exposure")
    grouped = _items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("cand_key"), "bucket", "name").agg(F.count("*").alias("n"), F.round(F.max(1 - F.col("l_discount")), 4).alias("confidence"))
    return grouped.where("n >= 2").select("cand_key", "bucket", "name", "n", strength.alias("strength"), "confidence")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return rows.selectExpr(
        "o_orderkey as job_key", "concat('job__', o_orderkey) as job_id", "lower(n_name) as location",
        "case o_orderstatus when 'F' then 'On-site' when 'O' then 'Hybrid' else 'Remote' end as remote_policy",
        "case o_orderpriority when '5-LOW' then 'junior' when '3-MEDIUM' then 'medior' when '2-HIGH' then 'senior' when '1-URGENT' then 'lead' end as seniority",
        "0.9D as seniority_confidence", "year(o_orderdate) % 8 as min_years", "case when o_orderkey % 4 = 0 then 'preferred' else 'required' end as years_level", "0.9D as years_confidence",
        "array_compact(array(case when o_orderkey % 37 = 0 then 'citizenship' end, case when o_orderkey % 17 = 0 then 'work_authorization' end, case when o_orderkey % 29 = 0 then 'controlled_technology' end)) as restrictions",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates, with lists of locations and single workplaces."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).selectExpr(
        "s_suppkey as cand_key", "concat('cand_', s_suppkey) as candidate_id", "case when s_suppkey % 4 = 0 then array(lower(n_name)) end as preferred_locations", "case when s_suppkey % 7 = 3 then array('france', 'Germany ') end as excluded_locations",
        "case s_suppkey % 3 when 0 then true when 1 then false end as requires_visa_sponsorship", "cast(null as boolean) as avoid_export_control_roles",
        "case s_suppkey % 6 when 0 then 'junior' when 1 then 'medior' when 2 then 'senior' when 3 then 'lead' when 4 then 'principal' else 'staff' end as seniority",
        "0.9D as seniority_confidence", "cast(s_suppkey % 12 as int) as years", "0.9D as years_confidence",
        "case s_suppkey % 3 when 0 then 'Remote' when 1 then 'Hybrid' end as preferred_workplace", "case s_suppkey % 5 when 0 then 'On-site' when 1 then 'Remote' end as excluded_workplace",
    )


def vacancy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a vacancy page: (page_id, url, host, title, disciplines, html), with tags, JSON-LD and labels before the page's own markup.

    Some of it is malformed or out of place: tags outside the wrapper, odd quotes, elements without an end, character references, JSON-LD with text
    after it or single quotes, a label that an element without the value holds first.
    """
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    tags = """concat('<b class="job-tag" title="Location"><i class="job-tag-value">Outside</i></b><p title=it\\'s><div class="job-tags-wrapper"><div>', if(page_id % 3 <> 0, concat('<span class="job-tag" data-type=" Location "><i></i><span class="job-tag-value"> ', host, ' </span></span>'), ''),
      if(page_id % 4 = 0, '<span class="tag job-tag" title="Education  Level"><span class="job-tag-value">Master</span></span>', ''),
      if(page_id % 5 = 0, '<b class="job-tag" title="Employment"><i class="job-tag-value">Part time</i></b><b class="job-tag" title="employment"><i class="job-tag-value">Full&#32; &#x74;ime</i></b>', ''), '</div></div>', '<b class="job-tag" title="Education level"><i class="job-tag-value">After</i></b>')"""
    ld = """if(page_id % 7 = 0, '', concat('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@type":"JobPosting","employmentType":"A"} junk</script>
      <script type="application/ld+json">{\\'@type\\':\\'JobPosting\\'}</script>', if(page_id % 7 = 1, '', concat('<script type="application/ld+json">[{"@type":"Thing"},{"@type":" jobposting",
      "jobLocation":{"address":{"addressLocality":"Site ', page_id % 13, '","addressCountry":"NL"}},"employmentType":"FULL_TIME"}]</script>'))))"""
    labels = """concat('<ul>', if(page_id % 2 = 0, concat('<li><span>Work experience</span><span>: ', page_id % 9 + 1, ' - ', page_id % 9 + 3, ' years</span></li>'), ''),
      if(page_id % 12 = 7, '<li><a>Jobs</a><a>Team</a></li>', ''), if(page_id % 6 = 1, concat('<li><div><b> Team </b><p> Team <u>', host, '</u></div></li>'), ''), '</ul>')"""
    main = """concat('<main><p>', host, ' builds systems for the semiconductor and medical industries. A Bachelor degree is asked for.</p><p>We offer ', page_id % 9 + 24, '-40 hours per week with room to work from home.</p>',
      '<p>From our office and at our clients\\' sites, you will work on challenging projects in the North region for all that we do there.</p></main>')"""
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("host", host)
    head = F.concat(F.lit("<body><h1>Vacancy "), F.col("page_id").cast("string"), F.lit("</h1>"), F.expr(tags), F.expr(ld), F.expr(labels), F.expr(main))
    return rows.select("page_id", "url", "host", F.lit(None).cast("string").alias("title"), F.array(F.lit("software"), F.lit("ai")).alias("disciplines"), F.concat(head, F.coalesce("html", F.lit(""))).alias("html"))


def vacancy_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, payload): what was extracted for the vacancy page of the same number as a document, from the document's columns."""

    def item(name: str, level: str) -> str:
        return f"named_struct('name', {name}, 'requirement_level', {level}, 'confidence', '0.75', 'evidence', array(lang))"

    none = "cast(array() as array<struct<name:string>>)"
    payload = f"""to_json(named_struct('skills', array({item("concat('  ', source)", "'preferred'")}, {item("upper(source)", "if(doc_id % 2 = 1, 'required', 'preferred')")}),
      'languages', array({item("lang", "if(doc_id % 3 = 0, 'required', 'preferred')")}), 'protocols', {none}, 'standards', {none}, 'domains', {none},
      'restrictions', if(doc_id % 5 = 0, array(named_struct('value', 'EU citizens', 'confidence', '1', 'evidence', array('e')), named_struct('value', 'nationality', 'confidence', '1', 'evidence', array('e'))), array()),
      'seniority', named_struct('value', if(doc_id % 4 = 0, ' Senior', null), 'confidence', '0.5', 'evidence', array('e'))))"""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    pages = table(spark, sf_dir, "pages").select("page_id", job_id(F.concat(F.lit("Vacancy "), F.col("page_id").cast("string")), F.col("url")).alias("job_id"))
    return pages.join(documents, pages.page_id == documents.doc_id).select("job_id", F.expr(payload).alias("payload"))
