"""caseload: household-survey and aid-caseload analytics as Spark DataFrame jobs.

Typical use::

    from caseload import build_cases, score, number_cases, load_case_tables
    cases = number_cases(score(build_cases(load_case_tables(spark, "/data/survey"))))
"""

from caseload.operators.cases import build_cases
from caseload.operators.scoring import number_cases, score
from caseload.sources.tables import load_case_tables, write_tables

__version__ = "0.1.0"
__all__ = ["build_cases", "score", "number_cases", "load_case_tables", "write_tables", "__version__"]
