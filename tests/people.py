"""Builders of nested candidate records."""

from __future__ import annotations

import copy
import json

from shortlist.schemas import candidate_schema

VALID = {
    "candidate_id": "CAND_0000001",
    "profile": {
        "anonymized_name": "Ada Example", "headline": "Engineer at X", "summary": "Builds things.", "location": "Pune",
        "country": "India", "years_of_experience": 5.0, "current_title": "Backend Engineer", "current_company": "X",
        "current_company_size": "51-200", "current_industry": "Software",
    },
    "career_history": [
        {"company": "X", "title": "Backend Engineer", "start_date": "2020-01-01", "end_date": None, "duration_months": 60,
         "is_current": True, "industry": "Software", "company_size": "51-200", "description": "Services."},
    ],
    "education": [
        {"institution": "Y", "degree": "BSc", "field_of_study": "CS", "start_year": 2012, "end_year": 2016, "grade": None,
         "tier": "tier_1"},
    ],
    "skills": [
        {"name": "Java", "proficiency": "advanced", "endorsements": 5, "duration_months": 60},
        {"name": "Spring", "proficiency": "advanced", "endorsements": 3, "duration_months": 48},
    ],
    "certifications": [{"name": "C1", "issuer": "I", "year": 2020}],
    "languages": [{"language": "English", "proficiency": "native"}],
    "signals": {
        "profile_completeness_score": 90.0, "signup_date": "2020-01-01", "last_active_date": "2024-05-01",
        "open_to_work_flag": True, "profile_views_received_30d": 10, "applications_submitted_30d": 2,
        "recruiter_response_rate": 0.5, "avg_response_time_hours": 4.0, "skill_assessment_scores": {"Java": 80.0},
        "connection_count": 10, "endorsements_received": 4, "notice_period_days": 30,
        "expected_salary_range_inr_lpa": {"min": 10.0, "max": 20.0}, "preferred_work_mode": "hybrid",
        "willing_to_relocate": True, "github_activity_score": 40.0, "search_appearance_30d": 3,
        "saved_by_recruiters_30d": 1, "interview_completion_rate": 0.9, "offer_acceptance_rate": -1.0,
        "verified_email": True, "verified_phone": True, "linkedin_connected": False,
    },
}


def person(n: int = 1, **changes) -> dict:
    """A valid record; keys with ``__`` reach into it, e.g. ``profile__current_title``."""
    record = copy.deepcopy(VALID)
    record["candidate_id"] = f"CAND_{n:07d}"
    for path, value in changes.items():
        target = record
        *parents, last = path.split("__")
        for key in parents:
            target = target[key]
        target[last] = value
    return record


def skill(name, proficiency="intermediate", duration=12, endorsements=1) -> dict:
    return {"name": name, "proficiency": proficiency, "endorsements": endorsements, "duration_months": duration}


def job(months=12, title="Engineer", company="X", start="2020-01-01", end="2021-01-01") -> dict:
    return {"company": company, "title": title, "start_date": start, "end_date": end, "duration_months": months,
            "is_current": False, "industry": "I", "company_size": "1-10", "description": "D"}


def frame(spark, records: list[dict]):
    """Records as a nested frame, without validation."""
    lines = [(json.dumps(r),) for r in records]
    df = spark.createDataFrame(lines, "value string")
    return df.selectExpr(f"from_json(value, '{candidate_schema()}') AS r").select("r.*")


def lines(spark, records: list):
    """Records or raw text as numbered lines."""
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "line_id bigint, value string")


def by_id(df) -> dict:
    return {r["candidate_id"]: r for r in df.collect()}
