"""All comparison SQL, by query name."""

from oracle import jobs, matching, people, ranking

ORACLE: dict[str, str] = {**people.SQL, **ranking.SQL, **jobs.SQL, **matching.SQL}
