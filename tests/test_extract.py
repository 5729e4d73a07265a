from pyspark.sql import functions as F

from rolefit.functions import extract as X
from rolefit.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, T.normalized(F.col("s")), s=" a\t\n b c ") == "a b c"
    assert one(spark, T.deduped_texts(F.col("s")), s=[" Eindhoven ", "eindhoven", "", " Hybrid  ", "hybrid"]) == ["Eindhoven", "Hybrid"]
    assert one(spark, T.title_slug(F.col("s")), s=" Senior C++ Engineer! ") == "senior_c_engineer"
    assert one(spark, T.title_slug(F.col("s")), s="!!") == "job" and one(spark, T.title_slug(F.col("s")), s=None) == "job"
    assert one(spark, T.job_id(F.col("t"), F.col("u")), t="A", u=None) == "a"
    assert one(spark, T.parsed_confidence(F.col("s")), s=" 0.12345 ") == 0.1235
    assert [one(spark, T.parsed_confidence(F.col("s")), s=x) for x in ("1.5", "x", None)] == [None] * 3
    assert one(spark, T.workplace_type(F.col("s")), s="Home Office") == "Remote"
    assert one(spark, T.contains_match(F.col("a"), F.col("b")), a="", b="x") is False
    assert one(spark, T.clamped_confidence(F.col("s").cast("double")), s=None) == 0.0
    assert one(spark, T.file_key(F.col("s"), "candidate_profile"), s="..") == "candidate_profile"


def test_years_and_hours(spark):
    pair = lambda f, s: tuple(one(spark, f(F.col("s")), s=s))
    assert pair(X.experience_years, "At least 6 years of work") == (6, None)
    assert pair(X.experience_years, "3 to 5 years") == (3, 5)
    assert pair(X.experience_years, "7+ years") == (7, None)
    assert pair(X.experience_years, "2 year") == (2, 2)
    assert pair(X.experience_years, None) == (None, None)
    assert pair(X.hours_per_week, "32- 40 hours per week") == (32, 40)
    got = one(spark, X.experience_fields(F.col("a"), F.col("b")), a="some", b="Nothing. You have experience. At least 4 years experience!")
    assert (got.low, got.high, got.text) == (4, None, "At least 4 years experience!")


def test_names_and_policy(spark):
    assert one(spark, X.industry_domains(F.col("s")), s="semiconductor, analytical, and medical in high-tech") == ["Semiconductor", "Analytical", "Medical", "High-tech"]
    assert one(spark, X.required_degrees(F.col("a"), F.col("b")), a=None, b="Master or bachelor's") == ["Master", "Bachelor"]
    assert one(spark, X.remote_policy(F.col("a"), F.col("b")), a=None, b="with room to work from home") == "Hybrid"
    assert one(spark, X.remote_policy(F.col("a"), F.col("b")), a="Home office", b=None) == "On-site"
    assert one(spark, X.restriction_class(F.col("s")), s="Ten years") == "controlled_technology"
    assert one(spark, X.requirement_level(F.col("s")), s="Go is a plus") == "preferred"


def test_recruiter_and_places(spark):
    got = one(spark, X.recruiter_contact(F.col("s")), s="See the GDPR regulations. Ann Lee Senior Recruiter +31 6 1234 5678 ann@x.example.com now")
    assert (got.name, got.role, got.email, got.phone) == ("Ann Lee", "Senior Recruiter", "ann@x.example.com", "+31 6 1234 5678")
    assert tuple(one(spark, X.recruiter_contact(F.col("s")), s="nothing")) == (None,) * 4
    got = one(spark, X.work_location(F.col("s")), s="From our office in Delft or at client sites, you will work in the Delft region.")
    assert got.place == "From our office in Delft or at client sites" and got.client_site is True and got.travel_region == "Delft region"
