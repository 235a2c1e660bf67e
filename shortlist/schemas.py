"""Record and table schemas.

``candidate_schema`` takes the name of the behavioural-signal struct, because inputs differ in
what they call it; inside the engine it is always ``signals``.
"""

from __future__ import annotations

SIGNALS_DDL = (
    "struct<profile_completeness_score:double,signup_date:string,last_active_date:string,"
    "open_to_work_flag:boolean,profile_views_received_30d:int,applications_submitted_30d:int,"
    "recruiter_response_rate:double,avg_response_time_hours:double,"
    "skill_assessment_scores:map<string,double>,connection_count:int,endorsements_received:int,"
    "notice_period_days:int,expected_salary_range_inr_lpa:struct<min:double,max:double>,"
    "preferred_work_mode:string,willing_to_relocate:boolean,github_activity_score:double,"
    "search_appearance_30d:int,saved_by_recruiters_30d:int,interview_completion_rate:double,"
    "offer_acceptance_rate:double,verified_email:boolean,verified_phone:boolean,linkedin_connected:boolean>"
)
PROFILE_DDL = (
    "struct<anonymized_name:string,headline:string,summary:string,location:string,country:string,"
    "years_of_experience:double,current_title:string,current_company:string,"
    "current_company_size:string,current_industry:string>"
)
CAREER_DDL = (
    "array<struct<company:string,title:string,start_date:string,end_date:string,duration_months:int,"
    "is_current:boolean,industry:string,company_size:string,description:string>>"
)
EDUCATION_DDL = (
    "array<struct<institution:string,degree:string,field_of_study:string,start_year:int,end_year:int,"
    "grade:string,tier:string>>"
)
SKILLS_DDL = "array<struct<name:string,proficiency:string,endorsements:int,duration_months:int>>"
CERTIFICATIONS_DDL = "array<struct<name:string,issuer:string,year:int>>"
LANGUAGES_DDL = "array<struct<language:string,proficiency:string>>"

CORRUPT = "_corrupt"


def candidate_schema(signals_field: str = "signals", corrupt: bool = False) -> str:
    """DDL of one nested candidate record."""
    fields = [
        "candidate_id string",
        f"profile {PROFILE_DDL}",
        f"career_history {CAREER_DDL}",
        f"education {EDUCATION_DDL}",
        f"skills {SKILLS_DDL}",
        f"certifications {CERTIFICATIONS_DDL}",
        f"languages {LANGUAGES_DDL}",
        f"{signals_field} {SIGNALS_DDL}",
    ]
    if corrupt:
        fields.append(f"{CORRUPT} string")
    return ", ".join(fields)


TABLES = ["profiles", "skills", "education", "career_history", "certifications", "languages"]

RANKING_DDL = "candidate_id string, rank int, score double, reasoning string"
LABELS_DDL = (
    "candidate_id string, label int, hybrid_score double, contradiction_score double, "
    "honeypot_score double, reason string"
)
