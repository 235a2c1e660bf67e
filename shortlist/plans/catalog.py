"""The registered queries: every operator over whole tables, ``(spark, folder) -> DataFrame``.

Results are plain columns (lists are joined to text, numbers rounded) so that they can be
compared with independent SQL. Operators that have no rows of their own are fed from the
derived profiles, job descriptions or the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions import text
from shortlist.functions.numbers import exact_round
from shortlist.operators import features as feat
from shortlist.operators import encoded, jd, lambdarank, ltr, normalise, phrases, positions, ranking, retrieval, scoring, screening, search, stats, textindex
from shortlist.plans import derived, pipeline, quality_inputs
from shortlist.plans.warehouse import warehouse
from shortlist.session import scratch, spread, staged
from shortlist.sources import files, ingest, tables
from shortlist.streaming import encoding
from shortlist.streaming import ingest as streaming

AS_OF_YEAR = 2026
TEXT_QUERY = "the data of reading and search the nation"
BASE_TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def six(column: str | Column, name: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 6).alias(name or column)


def joined(column: str | Column, name: str | None = None, by: str = "|") -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.array_join(value, by).alias(name or column)


def _role() -> feat.Role:
    r = derived.ROLE
    return feat.Role.of(
        r["must_have_skills"], r["required_experience_min"], r["required_experience_max"], r["seniority_level"]
    )


def _settings() -> pipeline.Settings:
    return pipeline.Settings(as_of_year=AS_OF_YEAR)


# --- ingest and validation ------------------------------------------------------------------


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.parse_lines(
        derived.raw_lines(warehouse(spark, folder).candidates), id_pattern=derived.ID_PATTERN, longest_career=derived.LONGEST_CAREER
    )


@register
def ingest_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines to valid nested records."""
    return ingest.valid_candidates(_checked(spark, folder)).select(
        "candidate_id", F.col("profile.headline").alias("headline"),
        F.length("profile.summary").alias("summary_length"), six("profile.years_of_experience", "years"),
        F.size("skills").alias("skill_count"), F.size("career_history").alias("job_count"),
        F.size("education").alias("school_count"), F.size("certifications").alias("cert_count"),
        F.size("languages").alias("language_count"), F.col("signals.last_active_date").alias("last_active_date"),
        six("signals.recruiter_response_rate", "response_rate"),
    )


@register
def validate_records(spark: SparkSession, folder: str) -> DataFrame:
    """V1: the constraints each record breaks."""
    return _checked(spark, folder).where("status <> 'blank'").select(
        "line_id", "status", F.coalesce(F.size("violations"), F.lit(0)).alias("violation_count"),
        F.coalesce(F.get("violations", F.lit(0)), "parse_error", F.lit("")).alias("first_violation"),
    )


@register
def convert_records(spark: SparkSession, folder: str) -> DataFrame:
    """V1 with conversion: the same lines, where a number written as text counts as that number."""
    found = ingest.parse_lines(
        derived.raw_lines(warehouse(spark, folder).candidates), id_pattern=derived.ID_PATTERN,
        longest_career=derived.LONGEST_CAREER, numbers="convert",
    )
    return found.where("status <> 'blank'").select(
        "line_id", "status", F.coalesce(F.size("violations"), F.lit(0)).alias("violation_count"),
        F.col("signals.connection_count").alias("connections"), six("signals.recruiter_response_rate", "response_rate"),
    )


@register
def line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as lines that carry their number in their file, blank lines between, read back with numbers."""
    path = _written(spark, "lines")
    texts = _documents(spark, folder).select("doc_id", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) * 2 + 1
    texts.select(F.concat_ws(" ", number, "doc_id", "text", F.lit("\n"))).write.text(path)
    lines = ingest.read_lines(spark, path).where("value <> ''")
    word = lambda n: F.split_part("value", F.lit(" "), F.lit(n)).cast("long")
    return lines.select(word(2).alias("doc_id"), (word(1) == F.col("line_id")).alias("same"))


@register
def quarantine_log(spark: SparkSession, folder: str) -> DataFrame:
    """V2: skipped lines with the reason."""
    return ingest.quarantine(_checked(spark, folder)).select("line_id", "reason")


@register
def load_stats(spark: SparkSession, folder: str) -> DataFrame:
    """V3."""
    return ingest.load_stats(_checked(spark, folder))


@register
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """M1, M3: the same lines through the streaming load; rows per stored table."""
    base = _written(spark, "stream")
    derived.raw_lines(warehouse(spark, folder).candidates).select("value").write.text(f"{base}/in", compression="gzip")
    streaming.load_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/state", files_per_batch=8, delete_loaded=True,
        id_pattern=derived.ID_PATTERN, longest_career=derived.LONGEST_CAREER,
    ).awaitTermination()
    out = None
    for name in (*normalise.NORMALISERS, "quarantine"):
        row = spark.read.parquet(f"{base}/out/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@register
def table_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """S4."""
    w = warehouse(spark, folder)
    return stats.table_catalog({name: w.table(name) for name in BASE_TABLES})


@register
def validate_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked lists with known faults."""
    rows = quality_inputs.ranked_lists(warehouse(spark, folder).table("customer"))
    found = ranking.validate_ranking(rows, n=quality_inputs.LIST_SIZE, id_pattern=derived.ID_PATTERN)
    return found.select("list_id", "rule", F.coalesce("row_num", F.lit(0)).alias("row_num"), "message")


@register
def weights_check(spark: SparkSession, folder: str) -> DataFrame:
    """V6."""
    return scoring.weights_check(quality_inputs.weight_rows(warehouse(spark, folder).table("part"))).select(
        "weights_id", six("total"), "problem", "ok"
    )


@register
def embedding_audit(spark: SparkSession, folder: str) -> DataFrame:
    """V7."""
    w = warehouse(spark, folder)
    return pipeline.embedding_audit(w.profiles, derived.candidate_vectors(spark, folder))


# --- normalised tables ------------------------------------------------------------------------


@register
def norm_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """P1, P7."""
    p = normalise.profiles(warehouse(spark, folder).candidates)
    doubles = {name for name, kind in p.dtypes if kind == "double"}
    ints = {name for name, kind in p.dtypes if kind in ("smallint", "int")}
    kept = [c for c in p.columns if c not in ("summary", "embedding_text")]
    return p.select(*[six(c) if c in doubles else F.col(c).cast("int") if c in ints else F.col(c) for c in kept])


@register
def norm_skills(spark: SparkSession, folder: str) -> DataFrame:
    """P2."""
    return normalise.skills(warehouse(spark, folder).candidates)


@register
def norm_education(spark: SparkSession, folder: str) -> DataFrame:
    """P3."""
    t = normalise.education(warehouse(spark, folder).candidates)
    return t.withColumns({c: F.col(c).cast("int") for c in ("start_year", "end_year")})


@register
def norm_career(spark: SparkSession, folder: str) -> DataFrame:
    """P4."""
    return normalise.career_history(warehouse(spark, folder).candidates).withColumn(
        "job_order", F.col("job_order").cast("int")
    )


@register
def norm_certifications(spark: SparkSession, folder: str) -> DataFrame:
    """P5."""
    return normalise.certifications(warehouse(spark, folder).candidates).withColumn("year", F.col("year").cast("int"))


@register
def norm_languages(spark: SparkSession, folder: str) -> DataFrame:
    """P6."""
    return normalise.languages(warehouse(spark, folder).candidates)


@register
def retrieval_text(spark: SparkSession, folder: str) -> DataFrame:
    """P8."""
    return warehouse(spark, folder).candidates.select("candidate_id", normalise.retrieval_text().alias("text"))


# --- search and presentation --------------------------------------------------------------------


@register
def search_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """F1-F4, J2, P9."""
    w = warehouse(spark, folder)
    return search.search_candidates(
        w.profiles, w.skills, q="engineer", skill="python", open_to_work=True, min_yoe=2.0, max_yoe=14.0,
    ).withColumn("skill_count", F.col("skill_count").cast("int"))


@register
def search_by_skill(spark: SparkSession, folder: str) -> DataFrame:
    """J2."""
    w = warehouse(spark, folder)
    return search.with_skill(w.profiles, w.skills, "learning").select("candidate_id", "current_title", "country")


@register
def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """P10: one page with the total next to each row."""
    w = warehouse(spark, folder)
    found = search.search_candidates(w.profiles, work_mode="remote")
    total = search.total_rows(found).scalar()
    return search.page(found, ["candidate_id"], offset=40, limit=20).select(
        "candidate_id", "headline", total.alias("total")
    )


@register
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """P10: a page far down all line items in price order, from the ranges that hold it."""
    rows = derived.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    stored = positions.ranged(rows, order)
    return positions.page(stored, order, offset=DEEP_OFFSET, limit=50).select("l_orderkey", "l_linenumber", six("l_extendedprice", "price"))


DEEP_OFFSET = 5400


@register
def mask_names(spark: SparkSession, folder: str) -> DataFrame:
    """P11."""
    return warehouse(spark, folder).profiles.select(
        "candidate_id", search.masked_name(F.col("anonymized_name")).alias("masked")
    )


@register
def candidate_detail(spark: SparkSession, folder: str) -> DataFrame:
    """J5, F5."""
    name = lambda c, field: joined(F.transform(c, lambda x: x[field]), c)
    return search.candidate_detail(warehouse(spark, folder).flat).select(
        "candidate_id", "headline", name("skills", "skill_name"), name("education", "institution"),
        name("career_history", "company"), name("certifications", "cert_name"), name("languages", "language"),
    )


# --- statistics ---------------------------------------------------------------------------------


@register
def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A1, A8."""
    return stats.dataset_stats(warehouse(spark, folder).profiles)


@register
def top_countries(spark: SparkSession, folder: str) -> DataFrame:
    """A2."""
    return stats.value_counts(warehouse(spark, folder).profiles, "country", "country", 10)


@register
def top_skills(spark: SparkSession, folder: str) -> DataFrame:
    """A2."""
    return stats.value_counts(warehouse(spark, folder).skills, "skill_name", "skill_name", 20)


@register
def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A3, A6."""
    w = warehouse(spark, folder)
    of_people = stats.facet_counts(
        w.profiles, ["preferred_work_mode", "current_title", "current_industry", "country", "notice_period_days"]
    )
    return of_people.unionByName(stats.facet_counts(w.skills, ["proficiency"]))


@register
def experience_bands(spark: SparkSession, folder: str) -> DataFrame:
    """A4."""
    return stats.band_counts(warehouse(spark, folder).profiles, "years_of_experience")


@register
def nested_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A5."""
    return stats.nested_counts(warehouse(spark, folder).candidates)


@register
def active_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """A7."""
    return stats.active_by_month(warehouse(spark, folder).profiles)


@register
def histogram20(spark: SparkSession, folder: str) -> DataFrame:
    """A9."""
    return stats.histograms(warehouse(spark, folder).profiles)


@register
def dataset_report(spark: SparkSession, folder: str) -> DataFrame:
    """K7, O5."""
    return stats.dataset_report(warehouse(spark, folder).candidates)


@register
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    """K9, O5."""
    return stats.dataset_summary(warehouse(spark, folder).candidates)


# --- retrieval ----------------------------------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(derived.table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def _document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return derived.table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@register
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and distinct tokens per document."""
    return _documents(spark, folder).select("doc_id", text.tokens(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"),
        F.coalesce(F.array_min("t"), F.lit("")).alias("first_token"),
        F.coalesce(F.array_max("t"), F.lit("")).alias("last_token"),
    )


@register
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """T1, F8, J10, O1."""
    return retrieval.bm25_topk(_documents(spark, folder), TEXT_QUERY, 100, "doc_id").select("doc_id", six("bm25_score"))


_INDEXES: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored index of all documents, written once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        path = _written(spark, "index")
        textindex.write(_documents(spark, folder), path, "doc_id")
        _INDEXES[key] = textindex.read(spark, path)
    return _INDEXES[key]


@register
def index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The query of ``bm25_topk`` over the stored block-max index."""
    return textindex.topk(_index(spark, folder), TEXT_QUERY, 100, "doc_id").select("doc_id", six("bm25_score"))


@register
def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    """A10: the numbers of the index."""
    index = retrieval.index_tables(_documents(spark, folder), "doc_id")
    corpus = index["corpus"].select(F.struct("n", "mean_length")).scalar()
    return index["terms"].agg(
        F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("highest_df"),
        F.count_if(F.col("df") == 1).alias("single_document_terms"),
    ).withColumn("c", corpus).select(
        "terms", "postings", "highest_df", "single_document_terms", F.col("c.n").alias("documents"),
        six("c.mean_length", "mean_length"),
    )


@register
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """T2, J9, O1."""
    vectors = _document_vectors(spark, folder)
    query = retrieval.stored_vector(vectors, 7, "doc_id")
    return retrieval.cosine_topk(vectors, query, 200, "doc_id").select("doc_id", six("semantic_score"))


@register
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """T3, J11, A11, O1."""
    vectors = _document_vectors(spark, folder)
    query = retrieval.stored_vector(vectors, 7, "doc_id")
    top = retrieval.hybrid_topk(_documents(spark, folder), vectors, TEXT_QUERY, query, 200, "doc_id")
    return top.select("doc_id", six("hybrid_score"), six("bm25_norm"), six("semantic_score"))


@register
def hybrid_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark passage as a query."""
    vectors = _document_vectors(spark, folder)
    queries = derived.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    ).join(vectors.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    top = retrieval.hybrid_batch(_documents(spark, folder), vectors, queries, k=10, id_col="doc_id")
    return top.select(
        "query_id", "rank", "doc_id", six("hybrid_score"), six("bm25_norm"), six("semantic_score")
    )


@register
def keyword_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """F6."""
    return retrieval.keyword_retrieve(
        warehouse(spark, folder).candidates, derived.ROLE["must_have_skills"], ["Data Scientist", "Backend Engineer"]
    )


@register
def union_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """T5, U1, J6."""
    vectors = derived.candidate_vectors(spark, folder)
    query = retrieval.stored_vector(vectors, "CAND_0000007")
    found = retrieval.union_retrieve(
        warehouse(spark, folder).candidates, vectors, query, derived.ROLE["must_have_skills"],
        ["Data Scientist", "Backend Engineer"], 200,
    )
    return found.select("candidate_id", six("semantic_score"))


@register
def embed_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the uncut texts of candidates that have none yet."""
    texts = normalise.whole_texts(warehouse(spark, folder).candidates)
    new = retrieval.embed_new(texts, derived.candidate_vectors(spark, folder))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return new.select("candidate_id", F.size("embedding").alias("dim"), F.round(length, 3).alias("norm"))


@register
def stream_embed(spark: SparkSession, folder: str) -> DataFrame:
    """M2: documents delivered by a stream, the even ones once more after a restart; every id is encoded once."""
    base = _written(spark, "stream-embed")
    texts = _documents(spark, folder).select(F.col("doc_id").alias("candidate_id"), F.col("text").alias("embedding_text"))
    odd = F.col("candidate_id") % 2 == 1
    texts.where(odd).unionByName(texts.where(odd)).write.parquet(f"{base}/in/first")
    for second in (False, True):
        if second:
            texts.write.parquet(f"{base}/in/second")
        arrivals = spark.readStream.schema(texts.schema).parquet(f"{base}/in/*")
        encoding.embed_stream(arrivals, f"{base}/out", f"{base}/state", make=encoded.digest_bag).awaitTermination()
    stored = spark.read.parquet(f"{base}/out")
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return stored.select(F.col("candidate_id").alias("doc_id"), F.size("embedding").alias("dim"), F.round(length, 3).alias("norm"))


# --- rules and features ---------------------------------------------------------------------------


@register
def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """R1, A12, U6."""
    return screening.with_contradictions(warehouse(spark, folder).candidates).select(
        "candidate_id", six("contradiction_score"), joined("contradiction_codes", "codes"),
        joined("contradiction_reasons", "reasons"),
    )


@register
def honeypots(spark: SparkSession, folder: str) -> DataFrame:
    """R2, J8, U6."""
    return screening.with_honeypots(warehouse(spark, folder).candidates, AS_OF_YEAR).select(
        "candidate_id", six("honeypot_probability"), joined("honeypot_codes", "codes"),
    )


@register
def negative_signals(spark: SparkSession, folder: str) -> DataFrame:
    """R3."""
    return screening.with_negative_signals(warehouse(spark, folder).candidates).select(
        "candidate_id", six("penalty"), joined("negative_codes", "codes"), joined("negative_reasons", "flags"),
    )


def _screened(spark: SparkSession, folder: str) -> DataFrame:
    return screening.with_fraud_scores(warehouse(spark, folder).candidates, AS_OF_YEAR)


@register
def fraud_gate(spark: SparkSession, folder: str) -> DataFrame:
    """F7."""
    return screening.fraud_gate(_screened(spark, folder)).select(
        "candidate_id", six("contradiction_score"), six("honeypot_probability")
    )


@register
def fraud_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """A17."""
    return stats.fraud_breakdown(_screened(spark, folder))


@register
def features31(spark: SparkSession, folder: str) -> DataFrame:
    """The 31-column set; similarities come from the stored vectors."""
    featured = feat.with_features_31(warehouse(spark, folder).candidates, _role())
    return _with_similarity(featured, spark, folder).select("candidate_id", *[six(c) for c in feat.FEATURES_31])


def _with_similarity(featured: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Fill in the similarity to one stored vector, 0 where a candidate has none.

    The features are made before the join, so numbers are shuffled and not whole profiles.
    """
    vectors = derived.candidate_vectors(spark, folder)
    scores = retrieval.cosine_scores(vectors, retrieval.stored_vector(vectors, "CAND_0000007"))
    return (
        featured.drop("embedding_similarity")
        .join(scores.withColumnRenamed("semantic_score", "embedding_similarity"), "candidate_id", "left")
        .withColumn("embedding_similarity", F.coalesce("embedding_similarity", F.lit(0.0)))
    )


@register
def features26(spark: SparkSession, folder: str) -> DataFrame:
    """The 26-column set."""
    return feat.with_features_26(warehouse(spark, folder).candidates).select(
        "candidate_id", *[six(c) for c in feat.FEATURES_26]
    )


@register
def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """W2."""
    return warehouse(spark, folder).candidates.select(
        "candidate_id", feat.promotions(F.col("career_history")).alias("promotions")
    )


@register
def skill_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """U2."""
    names = F.transform("skills", lambda s: F.lower(s["name"]))
    return warehouse(spark, folder).candidates.select(
        "candidate_id", six(feat.overlap_share(_role().must_have, names), "overlap")
    )


@register
def top_skills_per_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """W4."""
    return warehouse(spark, folder).candidates.select(
        "candidate_id", joined(scoring.top_skills(F.col("skills")), "top_skills")
    )


# --- scoring and ranking --------------------------------------------------------------------------


def _featured(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates with fraud scores and the 31 features; of the nested record the place and the years, as labels need no more."""
    made = feat.with_features_31(_screened(spark, folder), _role())
    kept = [c for c in made.columns if c not in pipeline.RECORD]
    made = made.select(*kept, F.struct("profile.location", "profile.years_of_experience").alias("profile"))
    return _with_similarity(made, spark, folder)


@register
def weighted_score(spark: SparkSession, folder: str) -> DataFrame:
    """R4, L2 without a model."""
    return _featured(spark, folder).select("candidate_id", six(scoring.weighted_score(), "score"))


def _components(featured: DataFrame) -> DataFrame:
    asked = F.lit(len(derived.ROLE["must_have_skills"]))
    return pipeline.components(featured).withColumn("matched", scoring.matched_skills(F.col("skill_overlap_score"), asked))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates with the components, the penalty and what a ranked list shows; the similarity joins numbers and short texts."""
    listed = pipeline.shown(feat.with_features_31(_screened(spark, folder), _role()))
    return _components(_with_similarity(listed, spark, folder))


def _penalised(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(spark, folder).withColumn("score", exact_round(scoring.penalised_score(), 6))


@register
def weighted_score_penalised(spark: SparkSession, folder: str) -> DataFrame:
    """R5."""
    return _penalised(spark, folder).select("candidate_id", six("penalty"), six("score"))


def _top(spark: SparkSession, folder: str, texts: DataFrame) -> DataFrame:
    vectors = derived.candidate_vectors(spark, folder)
    top = pipeline.rank_candidates(
        warehouse(spark, folder).candidates, texts, vectors, derived.ROLE["text"],
        retrieval.stored_vector(vectors, "CAND_0000007"), _role(), _settings(),
    )
    return top.select(
        "rank", "candidate_id", six("score"), six("feature_breakdown.embedding_similarity", "embedding_similarity"),
        six("feature_breakdown.bm25_score", "bm25_norm"),
        six("feature_breakdown.years_experience_score", "years_experience_score"),
    )


@register
def rank_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranking, by the texts of P8."""
    return _top(spark, folder, warehouse(spark, folder).profiles.select("candidate_id", "embedding_text"))


@register
def rank_whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """R6 as ``rank_candidates``, by the uncut texts."""
    return _top(spark, folder, normalise.whole_texts(warehouse(spark, folder).candidates))


@register
def rank_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """From the texts of jobs, one per benchmark item, to the hundred best candidates of each."""
    w = warehouse(spark, folder)
    jobs = staged(jd.requirements(jd.parse_jds(derived.benchmark_jobs(spark, folder))), "jobs")
    store = _written(spark, "query-vectors")
    asked = jobs.select(F.col("jd_id").alias("query_id"), F.col("summary_for_embedding").alias("query_text"))
    vectors = encoded.encoded_queries(asked, store, "digest-bag-64", make=encoded.digest_bag)
    jobs = jobs.join(vectors.select(F.col("query_id").alias("jd_id"), "query_vector"), "jd_id")
    texts = w.profiles.select("candidate_id", "embedding_text")
    known = texts.select("candidate_id", encoded.digest_bag(F.col("embedding_text")).alias("embedding"))
    top = pipeline.rank_jobs(w.candidates, texts, staged(known, "text-vectors"), jobs, _settings())
    breakdown = ["embedding_similarity", "bm25_score", "skill_overlap_score", "years_experience_score", "seniority_score"]
    return top.select("jd_id", "rank", "candidate_id", six("score"), *[six(f"feature_breakdown.{f}", f) for f in breakdown])


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.rank_shown(_listed(spark, folder), n=100)


@register
def rank_legacy(spark: SparkSession, folder: str) -> DataFrame:
    """R7, W1, W4, W5, R9."""
    return _ranked(spark, folder).select(
        "rank", "candidate_id", six("score"), joined("top_skills"), "title", joined("factors"),
    )


@register
def reasoning_text(spark: SparkSession, folder: str) -> DataFrame:
    """R9."""
    return _penalised(spark, folder).select("candidate_id", pipeline.reasoning().alias("reasoning"))


@register
def top_factors(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the three largest contributions."""
    names = F.transform(scoring.top_factors(), lambda f: F.substring_index(f, " (", 1))
    return _components(_featured(spark, folder)).select("candidate_id", joined(names, "factors"))


@register
def candidate_importance(spark: SparkSession, folder: str) -> DataFrame:
    """R8, O4."""
    items = scoring.candidate_importance()
    return _penalised(spark, folder).select("candidate_id", F.explode(items).alias("i")).select(
        "candidate_id", "i.feature", six("i.importance", "importance"), "i.direction"
    )


@register
def global_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Over the hundred best."""
    best = _penalised(spark, folder).orderBy(F.desc("score"), F.asc("candidate_id")).limit(100)
    return scoring.global_importance(best)


@register
def linear_contrib(spark: SparkSession, folder: str) -> DataFrame:
    """L4 for the weighted sum."""
    return _contributions(spark, folder).select("candidate_id", "feature", six("contribution"))


def _contributions(spark: SparkSession, folder: str) -> DataFrame:
    weights = scoring.Weights()
    by_feature = {f: getattr(weights, w) / 100.0 for w, f in scoring.WEIGHTED_FEATURES.items()}
    return ltr.linear_contributions(_featured(spark, folder).select("candidate_id", *by_feature), by_feature)


@register
def mean_abs_contrib(spark: SparkSession, folder: str) -> DataFrame:
    """A14, K5."""
    return ltr.mean_abs_contributions(_contributions(spark, folder)).select("feature", six("mean_abs"))


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with its score and fraud probability, as the ranked pool."""
    return _penalised(spark, folder)


@register
def score_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """P12, P13."""
    return _pool(spark, folder).select(
        "candidate_id", search.score_tier(F.col("score")).alias("tier"),
        search.fraud_flag(F.col("honeypot_probability")).alias("flagged"),
    )


@register
def pool_kpis(spark: SparkSession, folder: str) -> DataFrame:
    """A15."""
    return stats.pool_kpis(_pool(spark, folder))


@register
def score_bands(spark: SparkSession, folder: str) -> DataFrame:
    """A16."""
    return stats.band_counts(_pool(spark, folder), "score", stats.SCORE_BANDS)


@register
def compare_top2(spark: SparkSession, folder: str) -> DataFrame:
    """P14."""
    return search.compare_pair(
        _ranked(spark, folder), ["candidate_id", "title", "location", "notice_period_days", "years_of_experience"]
    )


@register
def search_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """F9, K8."""
    return search.search_ranked(_ranked(spark, folder), "data").select("candidate_id", "rank", six("score"))


def _written(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a query that writes and reads back."""
    path = scratch(spark, name)
    if path is None:
        raise ValueError(f"{name} needs a shared folder: set spark.checkpoint.dir")
    return path


@register
def search_export(spark: SparkSession, folder: str) -> DataFrame:
    """K8: the filtered ranking written as CSV and read back."""
    path = _written(spark, "search")
    files.write_search(search.search_ranked(_ranked(spark, folder), "data").select("candidate_id", "rank", six("score")), path)
    return spark.read.schema("candidate_id string, rank int, score double").csv(path, header=True)


@register
def ranking_file(spark: SparkSession, folder: str) -> DataFrame:
    """The ranked file written, read back and numbered by its rows."""
    path = _written(spark, "ranking")
    results = _penalised(spark, folder).select("candidate_id", "score", F.lit("").alias("reasoning"), F.lit(0).alias("input_pos"))
    files.write_ranking(results, path)
    rows, _ = files.read_ranking(spark, path)
    return rows.select("row_num", "candidate_id", "rank", "score", "columns")


@register
def labels_file(spark: SparkSession, folder: str) -> DataFrame:
    """The labels written as CSV and read back."""
    path = _written(spark, "labels")
    files.write_labels(_labelled(spark, folder), path)
    return files.read_labels(spark, path)


@register
def features_file(spark: SparkSession, folder: str) -> DataFrame:
    """K6: the feature table written and read back."""
    path = _written(spark, "features")
    tables.write_features(_featured(spark, folder).select("candidate_id", *feat.FEATURES_31), path)
    return spark.read.parquet(path).select("candidate_id", *[six(f) for f in feat.FEATURES_31])


@register
def importance_file(spark: SparkSession, folder: str) -> DataFrame:
    """The mean absolute contributions written, largest first, and read back."""
    path = _written(spark, "importance")
    files.write_importance(ltr.mean_abs_contributions(_contributions(spark, folder)), path, "mean_abs")
    return spark.read.schema("feature string, mean_abs double").csv(path, header=True).select("feature", six("mean_abs"))


@register
def dedupe_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The best order of each customer."""
    results = derived.table(spark, folder, "orders").select(
        derived.candidate_id(F.col("o_custkey")).alias("candidate_id"), F.floor(F.col("o_totalprice") / 1000).alias("score"),
        F.col("o_orderkey").alias("input_pos"),
    )
    return ranking.dedupe_best(results)


# --- labels and training ----------------------------------------------------------------------------


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    featured = _featured(spark, folder).withColumn("hybrid_score", F.col("embedding_similarity"))
    return scoring.pseudo_labels(featured, semantic="embedding_similarity")


@register
def pseudo_labels(spark: SparkSession, folder: str) -> DataFrame:
    """R10, R11."""
    return _labelled(spark, folder)


def _training(spark: SparkSession, folder: str) -> DataFrame:
    """Features, label and the place as query group, in one projection of the featured rows."""
    label = scoring.pseudo_label("embedding_similarity", "embedding_similarity")["label"]
    frame = _featured(spark, folder).select("candidate_id", "profile.location", label.alias("label"), *feat.FEATURES_31)
    return frame.withColumn("score", scoring.weighted_score())


@register
def features_labels(spark: SparkSession, folder: str) -> DataFrame:
    """J1."""
    return _training(spark, folder).select("candidate_id", "label", six("python_score"), six("average_tenure"))


@register
def ndcg_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the weighted score per place."""
    frame = _training(spark, folder).withColumn("score", F.round("score", 6))
    return ltr.ndcg(frame, (10, 50), group="location").select("location", six("ndcg_at_10"), six("ndcg_at_50"))


@register
def ltr_groups(spark: SparkSession, folder: str) -> DataFrame:
    """W6."""
    return ltr.synthetic_groups(warehouse(spark, folder).profiles.select("candidate_id"))


@register
def group_kfold(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as groups of their orders."""
    orders = derived.table(spark, folder, "orders").select(F.col("o_custkey").alias("group_id"))
    return ltr.group_folds(orders, 5)


@register
def ltr_cv(spark: SparkSession, folder: str) -> DataFrame:
    """L1, L2: held-out ranking quality per fold."""
    frame = ltr.synthetic_groups(_training(spark, folder).drop("score"))
    return ltr.cross_validate(frame, feat.FEATURES_31, k=3, params=ltr.RankerParams(trees=5, depth=3))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """The training frame with the rounded weighted score, places as groups."""
    return _training(spark, folder).withColumns({"score": F.round("score", 6), "group_id": F.coalesce("location", F.lit(""))})


@register
def lambda_gradients(spark: SparkSession, folder: str) -> DataFrame:
    """L1: the slopes that pairs within a place pull at the weighted score with."""
    rows = staged(_places(spark, folder).select("candidate_id", "group_id", "label", "score"), "lambda-places")
    ideal = lambdarank.ideal_gains(rows, 30, "group_id", "candidate_id")
    found = lambdarank.lambda_gradients(rows, ideal)
    return found.select("candidate_id", *[F.round(F.col(c) / lambdarank.UNIT, 6).alias(c) for c in ("slope", "curve")])


LAMBDA_TREE = lambdarank.LambdaParams(trees=1, depth=2, learning_rate=0.1)
LAMBDA_BINS = 16


def _first_tree(spark: SparkSession, folder: str) -> tuple[lambdarank.Ranker, DataFrame]:
    frame = _places(spark, folder).select("candidate_id", "group_id", "label", *map(six, feat.FEATURES_31))
    frame = staged(frame, "lambda-frame")
    edges = lambdarank.equal_edges(frame, feat.FEATURES_31, LAMBDA_BINS)
    return lambdarank.fit(frame, feat.FEATURES_31, LAMBDA_TREE, edges=edges), frame


@register
def lambda_tree(spark: SparkSession, folder: str) -> DataFrame:
    """L1, L3: the first tree of the pairwise ranker, node by node."""
    model, _ = _first_tree(spark, folder)
    rows = [
        (number, feat.FEATURES_31[n.feature] if n.feature >= 0 else None, n.edge if n.feature >= 0 else None, n.gain, n.rows, n.value)
        for number, n in sorted(model.trees[0].nodes.items())
    ]
    made = spark.createDataFrame(rows, "node int, feature string, edge double, gain double, rows long, value double")
    return made.select("node", "feature", six("edge"), F.round("gain", 4).alias("gain"), "rows", six("value"))


@register
def tree_contrib(spark: SparkSession, folder: str) -> DataFrame:
    """L4: what every feature adds to every candidate's prediction by that tree."""
    model, frame = _first_tree(spark, folder)
    return lambdarank.contributions(model, frame).select("candidate_id", "feature", six("contribution"))


@register
def tree_mean_abs(spark: SparkSession, folder: str) -> DataFrame:
    """The mean absolute contribution per feature."""
    return ltr.mean_abs_contributions(lambdarank.contributions(*_first_tree(spark, folder))).select("feature", six("mean_abs"))


@register
def lambda_cv(spark: SparkSession, folder: str) -> DataFrame:
    """L1, L2: held-out ranking quality of the pairwise ranker per fold."""
    frame = ltr.synthetic_groups(_training(spark, folder).drop("score"))
    return lambdarank.cross_validate(frame, feat.FEATURES_31, k=3, params=lambdarank.LambdaParams(trees=3, depth=3, learning_rate=0.2))


# --- job descriptions -------------------------------------------------------------------------------


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return derived.job_descriptions(spark, folder).select("jd_id", text.normalised(F.col("text")).alias("clean")).select(
        "jd_id", "clean", F.lower("clean").alias("low")
    )


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return jd.parse_jds(derived.job_descriptions(spark, folder))


@register
def jd_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """X1."""
    return _clean(spark, folder).select("jd_id", F.md5("clean").alias("digest"), F.length("clean").alias("chars"))


@register
def jd_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """X2."""
    return _clean(spark, folder).select("jd_id", text.sentences(F.col("clean")).alias("s")).select(
        "jd_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n\n")).alias("digest")
    )


@register
def jd_sections(spark: SparkSession, folder: str) -> DataFrame:
    """One row per section."""
    return _clean(spark, folder).select("jd_id", F.explode(text.sections(F.col("clean"))).alias("section", "body")).select(
        "jd_id", "section", F.length("body").alias("chars"), F.md5("body").alias("digest")
    )


@register
def jd_skill_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """X3, J7, O3, U3."""
    found = jd.with_skills(jd.with_clean_text(derived.job_descriptions(spark, folder)))
    listed = F.concat("must_have", "nice_to_have")
    return found.select("jd_id", F.explode(listed).alias("m")).select(
        "jd_id", "m.name", "m.context", six("m.confidence", "confidence"), "m.section"
    )


@register
def jd_word_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions as whole words, by a join of word runs with the spellings."""
    found = phrases.word_mentions(jd.with_clean_text(derived.job_descriptions(spark, folder)))
    return found.select("jd_id", "name", "context", six("confidence"), "section")


@register
def jd_experience(spark: SparkSession, folder: str) -> DataFrame:
    """X4, X4b."""
    e = F.col("e")
    return _clean(spark, folder).select("jd_id", jd.experience(F.col("clean")).alias("e")).select(
        "jd_id", e["min"].alias("years_min"), e["max"].alias("years_max"),
        jd.midpoint(e["min"], e["max"]).alias("midpoint"), e["raw"].alias("raw"),
    )


@register
def jd_seniority(spark: SparkSession, folder: str) -> DataFrame:
    """X5, X5b."""
    found = _clean(spark, folder).select(
        "jd_id", jd.experience(F.col("clean")).alias("e"), jd.stated_seniority(F.col("low")).alias("s")
    )
    final = jd.reconciled_seniority(F.col("s"), F.col("e.min"), F.col("e.max"))
    return found.select("jd_id", F.col("s.level").alias("stated"), final.alias("f")).select(
        "jd_id", "stated", F.col("f.level").alias("level"), six("f.confidence", "confidence")
    )


@register
def jd_industries(spark: SparkSession, folder: str) -> DataFrame:
    """X6."""
    return _clean(spark, folder).select("jd_id", joined(jd.industries(F.col("low")), "industries"))


@register
def jd_location(spark: SparkSession, folder: str) -> DataFrame:
    """X7."""
    return _clean(spark, folder).select("jd_id", jd.location(F.col("low")).alias("l")).select("jd_id", "l.*")


@register
def jd_startup(spark: SparkSession, folder: str) -> DataFrame:
    """X8."""
    return _clean(spark, folder).select("jd_id", jd.startup_signals(F.col("low")).alias("s")).select(
        "jd_id", *[F.col(f"s.{name}").alias(name) for name in jd.STARTUP_FLAGS], "s.funding_stage",
        joined("s.signals", "signals"),
    )


@register
def jd_leadership(spark: SparkSession, folder: str) -> DataFrame:
    """X9."""
    return _clean(spark, folder).select("jd_id", jd.leadership_signals(F.col("clean")).alias("s")).select(
        "jd_id", *[F.col(f"s.{name}").alias(name) for name in jd.LEADERSHIP_FLAGS], "s.min_direct_reports",
        "s.max_direct_reports", joined("s.signals", "signals"),
    )


@register
def jd_negative(spark: SparkSession, folder: str) -> DataFrame:
    """X10."""
    return _clean(spark, folder).select("jd_id", F.explode(jd.negative_signals(F.col("clean"))).alias("n")).select(
        "jd_id", "n.signal", "n.category", "n.raw"
    )


@register
def jd_titles(spark: SparkSession, folder: str) -> DataFrame:
    """X11, U5."""
    return _clean(spark, folder).select("jd_id", joined(jd.target_titles(F.col("clean"), F.col("low")), "titles"))


@register
def jd_salary(spark: SparkSession, folder: str) -> DataFrame:
    """X12."""
    return _clean(spark, folder).select("jd_id", jd.salary(F.col("clean")).alias("s")).select(
        "jd_id", F.col("s.min").alias("salary_min"), F.col("s.max").alias("salary_max")
    )


@register
def jd_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """The hand-off of every description."""
    wanted = jd.requirements(_parsed(spark, folder))
    return wanted.select(
        "jd_id", joined("must_have_skills"), joined("nice_to_have_skills"), "required_experience_min",
        "required_experience_max", "seniority_level", joined("required_industries"), "production_ml_requirements",
        joined("negative_signals"), F.col("location_requirements.city").alias("city"), "work_mode_requirements",
        F.length("summary_for_embedding").alias("summary_chars"),
    )


