"""Candidate profiles and job descriptions derived from the star-schema tables.

The test tables hold no people, so a deterministic profile is built for every customer with
integer arithmetic: orders become jobs, line items become skills, events become behavioural
signals and documents become summaries. The size follows the tables. Per-candidate lists are
whole: every order is a job, so a career is as long as a customer's orders, and there are at most
``SKILL_LIMIT`` differently named skills. Ids have seven digits and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.arrays import words
from shortlist.schemas import CERTIFICATIONS_DDL, EDUCATION_DDL, LANGUAGES_DDL
from shortlist.session import spread

# --- fixture vocabularies -----------------------------------------------------------------

TITLES = [
    "Senior Machine Learning Engineer", "Marketing Manager", "Frontend Developer", "Backend Engineer",
    "AI Engineer", "Data Scientist", "Technical Recruiter", "Principal Engineer", "UI Designer",
    "Engineering Manager", "Staff Data Scientist", "Sales Lead",
]
SUMMARY_ENDINGS = [
    "", " Worked at a startup doing AI.", " Seasoned software engineer.", " Builds search and ranking systems.",
    " Enjoys mentoring.",
]
SKILLS = [
    "Python", "PyTorch", "TensorFlow", "LLM", "Transformers", "LangChain", "Machine Learning", "Deep Learning",
    "Docker", "Kubernetes", "MLOps", "Pinecone", "Weaviate", "Milvus", "Qdrant", "FAISS", "BM25",
    "Elasticsearch", "Solr", "Retrieval", "Ranking", "Learning to Rank", "XGBoost", "LightGBM", "GPT",
    "LlamaIndex", "HuggingFace", "LoRA", "PEFT", "ChatGPT", "GenAI", "Generative AI", "Prompt Engineering",
    "scikit-learn", "React", "Angular", "Vue", "CSS", "HTML", "JavaScript", "Java", "Spring", "Golang", "C#",
    "AWS", "GCP", "Azure", "Keras", "Postgres", "MongoDB", "Cassandra", "Redis", "Nursing", "Plumbing", "HR",
    "Payroll", "SQL", "Spark", "Kafka", "Airflow",
]
LANGUAGES = ["English", "Hindi", "German", "French", "Tamil"]
SKILL_LIMIT = len(SKILLS) + 2000

JD_TEMPLATES = [
    "Senior Search Engineer\nPune (Hybrid)\n\nAbout Us\nShops use our search boxes. A startup after its Series B, "
    "with high ownership and equity for all.\n\nRequirements\n- 6-9 years of building retrieval systems required\n"
    "- Daily work in Python and PyTorch\n- Pinecone or FAISS, Docker, RAG\n\nPreferred\n- A first project with "
    "LangChain\n- Having run MLflow is a plus\n\nCompensation\n- 35-70 LPA\n",
    "Junior Data Analyst\nChennai, in-office only\n\nWhat you need:\n- 0-1 years, some pandas, some NumPy\n- Queries "
    "in SQL required\n\nGood to have:\n- A course on AWS\n",
    "Director of Data Platforms\n\nRequirements:\n- minimum 14 years, most of them with Spark\n- Manage a team of 6-9 "
    "people\n- Must have run Kafka at night\n\nNice to have\n- Kubernetes\n",
    "NLP Engineer for claims\ninsurance, Remote\n\nMandatory\n- 4+ years\n- Named entities with BERT; Elasticsearch "
    "required\n- INR 20-38 LPA\n- visa sponsorship for the right person\n",
    "Our shop page needs care: JavaScript in front, Python behind.\nTwo releases a week, 3 years of experience "
    "required. Remote.\n",
    "Role: Build Engineer\nSingapore\nexperience of 5 years\nTerraform is essential, Kubernetes too.\nRs 28 LPA\n"
    "relocation paid\n",
    "Principal Engineer\nBerlin, flexible\n12+ years of Java or Scala, all of them with Kafka\nOwns the technical "
    "roadmap\nhealthcare devices and robotics\n",
    "Intern, remote\nFreshers only; no prior ML experience required. Immediate joiner.\nLondon\n",
]

ROLE = {
    "text": "Senior Python engineer with Docker, Kubernetes, Pinecone and Elasticsearch; machine learning, retrieval "
    "and ranking of data in the field",
    "must_have_skills": ["Python", "Docker", "Pinecone", "Elasticsearch"],
    "required_experience_min": 4.0,
    "required_experience_max": 9.0,
    "seniority_level": "senior",
}


# --- scans ------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.get(words(values), F.pmod(index, F.lit(len(values))).cast("int"))


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


#: What the ids made here look like, and that their careers may have any length.
ID_PATTERN, LONGEST_CAREER = "^CAND_[0-9]{7,}$", None


def candidate_id(key: Column) -> Column:
    """Padded to seven digits; longer keys stay whole."""
    digits = key.cast("string")
    return F.concat(F.lit("CAND_"), F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0")))


# --- parts of a profile -------------------------------------------------------------------


def _careers(orders: DataFrame) -> DataFrame:
    """All orders of each customer, oldest first, as they are stored: ``_jobs`` words them once nothing moves them any more."""
    order = F.struct("o_orderdate", "o_orderkey", "o_orderpriority")
    return (
        orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
        .repartition("o_custkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.array_sort(F.collect_list(order)).alias("ordered"))
    )


def _jobs(ordered: str, customer: Column) -> Column:
    """A job for every order of ``_careers``."""

    def job(order: Column) -> Column:
        key = order["o_orderkey"]
        days = (F.pmod(key, F.lit(900)) - 30).cast("int")
        title = F.when(F.pmod(customer, F.lit(4)) == 0, _pick(["Marketing Manager", "Sales Lead"], key)).otherwise(_pick(TITLES, key))
        current = F.pmod(key, F.lit(10)) == 0
        start = F.to_date(order["o_orderdate"])
        return F.struct(
            F.when(F.pmod(key, F.lit(97)) == 0, "Amazon Retail")
            .otherwise(F.concat(F.lit("ORG"), F.pmod(key, F.lit(5)).cast("string")))
            .alias("company"),
            title.alias("title"),
            _day(start).alias("start_date"),
            F.when(~current, _day(F.date_add(start, days))).alias("end_date"),
            F.pmod(key, F.lit(25)).cast("int").alias("duration_months"),
            current.alias("is_current"),
            _pick(["Finance", "Retail", "Energy"], key).alias("industry"),
            _pick(vocab.COMPANY_SIZES, key).alias("company_size"),
            F.concat(F.lit("Handled "), order["o_orderpriority"], F.lit(" work")).alias("description"),
        )

    return F.transform(ordered, job)


def skill_name(partkey: Column) -> Column:
    return F.when(F.pmod(partkey, F.lit(240)) < 120, _pick(SKILLS, partkey)).otherwise(
        F.concat(F.lit("skill_"), F.pmod(partkey, F.lit(2000)).cast("string"))
    )


def _skills(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The smallest part and largest quantity of every distinct skill name per customer.

    Line items move once more after they have met their orders, as three numbers; names follow from the part.
    """
    bought = (
        lineitem.select("l_orderkey", "l_partkey", "l_quantity")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "l_partkey", "l_quantity")
        .repartition("o_custkey")
        .groupBy("o_custkey", skill_name(F.col("l_partkey")).alias("name"))
        .agg(F.min("l_partkey").alias("pk"), F.max("l_quantity").alias("quantity"))
    )
    return bought.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("pk", "quantity"))).alias("listed"))


def _named_skills(listed: str) -> Column:
    """The skills of ``_skills`` as a profile holds them."""
    return F.transform(
        listed,
        lambda s: F.struct(
            skill_name(s["pk"]).alias("name"),
            _pick(vocab.PROFICIENCIES, s["pk"]).alias("proficiency"),
            s["quantity"].cast("int").alias("endorsements"),
            F.pmod(s["pk"] * 13, F.lit(140)).cast("int").alias("duration_months"),
        ),
    )


def _skill_scores(listed: str) -> Column:
    assessed = F.filter(listed, lambda s: F.pmod(s["pk"], F.lit(7)) == 0)
    return F.map_from_arrays(
        F.transform(assessed, lambda s: skill_name(s["pk"])), F.transform(assessed, lambda s: F.pmod(s["pk"], F.lit(101)).cast("double"))
    )


def _signals(events: DataFrame) -> DataFrame:
    """Counts per user slot; there are never more than 150 slots, whatever the size of the table."""
    kind = F.col("event_type")
    return events.groupBy(F.pmod("user_id", F.lit(150)).alias("slot")).agg(
        F.count_if(kind == "view").alias("views"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("purchases"),
        F.count_if(kind == "error").alias("errors"),
        F.max("ts").alias("last_seen"),
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One nested, valid profile per customer with at least one order."""
    orders, lineitem = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    slots = F.broadcast(_signals(table(spark, folder, "events")))  # at most 150 rows
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("c_custkey"), "text")
    people = (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(slots, F.pmod("c_custkey", F.lit(150)) == F.col("slot"), "left")
        .join(documents, "c_custkey", "left")
        .join(_careers(orders), "c_custkey")
        .join(_skills(orders, lineitem), "c_custkey", "left")
    )
    k = F.col("c_custkey")

    def mod(n: int, factor: int = 1) -> Column:
        return F.pmod(k * factor, F.lit(n))

    def count_of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("int")

    company = F.concat(F.lit("ORG"), mod(50).cast("string"))
    title = _pick(TITLES, k)
    seen = count_of("purchases") + count_of("errors")
    rate = F.when(mod(9) == 0, 1.0).when(seen == 0, 0.0).otherwise(F.round(count_of("purchases") / seen, 2))
    profile = F.struct(
        F.concat("c_mktsegment", F.lit(" "), "c_name").alias("anonymized_name"),
        F.concat(title, F.lit(" at "), company).alias("headline"),
        F.concat(F.coalesce("text", F.lit("")), _pick(SUMMARY_ENDINGS, k)).alias("summary"),
        F.concat("n_name", F.lit(" City")).alias("location"),
        F.when(mod(3) == 0, "India").otherwise(F.col("n_name")).alias("country"),
        (mod(150, 7) / 10.0).alias("years_of_experience"),
        title.alias("current_title"),
        company.alias("current_company"),
        _pick(vocab.COMPANY_SIZES, k).alias("current_company_size"),
        F.col("c_mktsegment").alias("current_industry"),
    )
    numbers = F.sequence(F.lit(0), F.lit(1))

    def listed(count: Column, build, ddl: str) -> Column:
        return F.transform(F.filter(numbers, lambda i: i < count), build).cast(ddl)

    education = listed(
        mod(3),
        lambda i: F.struct(
            F.concat(F.lit("Institute "), mod(30).cast("string")),
            F.lit("BSc"),
            F.lit("Science"),
            (F.lit(2000) + F.pmod(k + i, F.lit(20))).cast("int"),
            (F.lit(2000) + F.pmod(k + i, F.lit(20)) + mod(6) - 1 + i).cast("int"),
            F.when(mod(4) != 0, "A"),
            _pick(vocab.EDUCATION_TIERS, k + i),
        ),
        EDUCATION_DDL,
    )
    certs = listed(
        mod(3),
        lambda i: F.struct(
            F.concat(F.lit("Cert "), F.pmod(k + i * 5, F.lit(12)).cast("string")),
            F.concat(F.lit("Issuer "), F.pmod(k + i * 5, F.lit(4)).cast("string")),
            (F.lit(2010) + F.pmod(k + i * 5, F.lit(12))).cast("int"),
        ),
        CERTIFICATIONS_DDL,
    )
    spoken = listed(
        mod(2) + 1,
        lambda i: F.struct(_pick(LANGUAGES, k + i), _pick(vocab.LANGUAGE_LEVELS, k + i)),
        LANGUAGES_DDL,
    )
    no_skills = F.array().cast("array<struct<name:string,proficiency:string,endorsements:int,duration_months:int>>")
    signals = F.struct(
        mod(101, 11).cast("double").alias("profile_completeness_score"),
        _day(F.date_add(F.lit("2020-01-01").cast("date"), mod(1000).cast("int"))).alias("signup_date"),
        F.coalesce(_day(F.col("last_seen")), F.lit("2024-01-01")).alias("last_active_date"),
        (mod(3) != 0).alias("open_to_work_flag"),
        F.pmod(count_of("views") * 97, F.lit(1500)).cast("int").alias("profile_views_received_30d"),
        count_of("clicks").alias("applications_submitted_30d"),
        rate.alias("recruiter_response_rate"),
        (mod(72) / 2.0).alias("avg_response_time_hours"),
        F.coalesce(_skill_scores("listed"), F.create_map().cast("map<string,double>")).alias("skill_assessment_scores"),
        mod(500).cast("int").alias("connection_count"),
        mod(200, 3).cast("int").alias("endorsements_received"),
        mod(181, 17).cast("int").alias("notice_period_days"),
        F.struct(
            (mod(40) + 5).cast("double").alias("min"), (mod(40) + 5 + mod(15)).cast("double").alias("max")
        ).alias("expected_salary_range_inr_lpa"),
        _pick(vocab.WORK_MODES, k).alias("preferred_work_mode"),
        (mod(2) == 0).alias("willing_to_relocate"),
        F.when(mod(8) == 0, -1.0).otherwise(mod(101, 7).cast("double")).alias("github_activity_score"),
        mod(300).cast("int").alias("search_appearance_30d"),
        mod(40).cast("int").alias("saved_by_recruiters_30d"),
        (mod(101) / 100.0).alias("interview_completion_rate"),
        F.when(mod(6) == 0, -1.0).otherwise(mod(11) / 10.0).alias("offer_acceptance_rate"),
        (mod(5) != 0).alias("verified_email"),
        (mod(7) != 0).alias("verified_phone"),
        (mod(2) == 1).alias("linkedin_connected"),
    )
    return people.select(
        candidate_id(k).alias("candidate_id"),
        profile.alias("profile"),
        _jobs("ordered", k).alias("career_history"),
        education.alias("education"),
        F.coalesce(_named_skills("listed"), no_skills).alias("skills"),
        certs.alias("certifications"),
        spoken.alias("languages"),
        signals.alias("signals"),
    )


# --- other derived inputs -------------------------------------------------------------------

BROKEN_EVERY = 20


def raw_lines(nested: DataFrame) -> DataFrame:
    """Profiles as JSON lines, with some lines broken in a known way by ``id mod 20``.

    0 bad id, 1 too many years, 2 empty career, 3 unknown work mode, 4 rate above one,
    5 negative endorsements on every skill, 6 no profile, 7 cut off, 8 an extra blank line,
    9 a number written as text; the others are left alone.
    """
    n = F.expr("substring(candidate_id, 6)").cast("long")
    kind = F.pmod(n, F.lit(BROKEN_EVERY))
    skills = F.transform("skills", lambda s: s.withField("endorsements", F.lit(-1)))
    changed = nested.select(
        n.alias("line_id"),
        kind.alias("kind"),
        F.when(kind == 0, F.concat(F.lit("X"), "candidate_id")).otherwise(F.col("candidate_id")).alias("candidate_id"),
        F.when(kind == 6, F.lit(None))
        .when(kind == 1, F.col("profile").withField("years_of_experience", F.lit(51.0)))
        .otherwise(F.col("profile"))
        .alias("profile"),
        F.when(kind == 2, F.slice("career_history", 1, 0)).otherwise(F.col("career_history")).alias("career_history"),
        "education",
        F.when(kind == 5, skills).otherwise(F.col("skills")).alias("skills"),
        "certifications",
        "languages",
        F.when(kind == 3, F.col("signals").withField("preferred_work_mode", F.lit("moon")))
        .when(kind == 4, F.col("signals").withField("recruiter_response_rate", F.lit(1.2)))
        .otherwise(F.col("signals"))
        .alias("signals"),
    )
    fields = [c for c in changed.columns if c not in ("line_id", "kind")]
    line = F.to_json(F.struct(*fields))
    value = (
        F.when(F.col("kind") == 7, F.substring(line, 1, 40))
        .when(F.col("kind") == 9, F.regexp_replace(line, '"connection_count":(\\d+)', '"connection_count":"$1"'))
        .otherwise(line)
    )
    lines = changed.select((F.col("line_id") * 2).alias("line_id"), "kind", value.alias("value"))
    return lines.select(
        F.explode(
            F.when(
                F.col("kind") == 8,
                F.array(
                    F.struct("line_id", "value"),
                    F.struct((F.col("line_id") + 1).alias("line_id"), F.lit("  ").alias("value")),
                ),
            ).otherwise(F.array(F.struct("line_id", "value")))
        ).alias("l")
    ).select("l.line_id", "l.value")


def job_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """One job description per document: a template by ``doc_id`` and then the whole text."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return documents.select(
        F.col("doc_id").alias("jd_id"),
        F.concat(_pick(JD_TEMPLATES, F.col("doc_id")), F.lit("\n"), "text").alias("text"),
    )


def benchmark_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job description per benchmark item: a template by ``item_id`` and then the item's text."""
    items = table(spark, folder, "benchmark").select("item_id", "text")
    return items.select(F.col("item_id").alias("jd_id"), F.concat(_pick(JD_TEMPLATES, F.col("item_id")), F.lit("\n"), "text").alias("text"))


def candidate_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors under candidate ids; only some candidates have one."""
    return table(spark, folder, "embeddings").select(
        candidate_id(F.col("vec_id")).alias("candidate_id"), "embedding"
    )
