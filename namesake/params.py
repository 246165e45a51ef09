"""Weights, thresholds and lists. Fixed values, given as text; all can be replaced by a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

# Name scores.
FIRST = {"exact": 1.852, "initial": 0.441, "fuzzy": -0.75, "missing": -1.941, "same_initial": -2.646, "conflict": -3.087, "no_target": -1.323}
LAST = {"exact": 0.664, "fuzzy": 0.332, "conflict": -0.996, "no_target": -0.996}
MIDDLE = {"exact": 1.588, "exact_initial": 1.191, "initial": 0.794, "missing": -0.794, "fuzzy": 0.0, "conflict": -1.588, "no_target": -1.588, "identity_has_none": 0.794}
MODIFIER = {"combined_first_last": 0.451, "swapped": -0.804, "article_last_in_identity": -0.804, "identity_last_in_article": -1.608, "identity_first_starts_article": -1.608, "first_middle_in_article": 0.804, "combined_middle_last": 0.0}
SUFFIXES = ["Jr", "Jr.", "MD PhD", "MD-PhD", "PhD", "MD", "III", "III.", "II", "II.", "Sr", "Sr."]

# The other evidence.
EMAIL = {"match": 8.0, "none": -1.0}
AFFILIATION = {"individual": 1.8, "institution": 1.0, "none": -0.8}
DEPARTMENT_SCORE, COMMON_DEPARTMENT = 0.6, "medicine"
SUBFIELD_SCORE = 0.47
GENDER_LEAST, GENDER_RANGE = -1.36, 1.6
ARTICLES_THRESHOLD, ARTICLES_WEIGHT = 800, 583.9
AUTHORS_SLOPE, AUTHORS_CONSTANT = -0.2461, 1.98
BACHELOR_SHIFT = -7

# Score of an article from 99 years before the degree to 100 years after it, a value for each year.
DEGREE_SCORES = [
    -12.6, -12.5, -12.4, -12.3, -12.2, -12.1, -12.0, -11.9, -11.8, -11.7, -11.6, -11.5, -11.4, -11.3, -11.2, -11.1, -11.0, -10.9, -10.8, -10.7,
    -10.6, -10.5, -10.4, -10.3, -10.2, -10.1, -10.0, -9.9, -9.8, -9.7, -9.6, -9.5, -9.4, -9.3, -9.2, -9.1, -9.0, -8.9, -8.8, -8.7,
    -8.6, -8.5, -8.4, -8.3, -8.2, -8.1, -8.0, -7.9, -7.8, -7.7, -7.6, -7.5, -7.4, -7.3, -7.2, -7.1, -7.0, -6.9, -6.8, -6.7,
    -6.6, -6.5, -6.4, -6.3, -6.2, -6.1, -6.0, -5.9, -5.8, -5.7, -5.6, -5.5, -5.4, -5.3, -5.2, -5.1, -5.0, -4.9, -4.8, -4.7,
    -4.6, -4.5, -4.4, -4.3, -4.2, -4.1, -4.0, -3.78, -3.56, -3.34, -3.12, -2.9, -2.68, -2.46, -2.24, -2.02, -1.8, -1.58, -1.36, -1.16,
    -0.96, -0.76, -0.56, -0.36, -0.175, 0.01, 0.195, 0.38, 0.55, 0.72, 0.89, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9,
    0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9,
    0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.89, 0.88, 0.86, 0.85, 0.83, 0.81, 0.8, 0.77, 0.75, 0.73, 0.7, 0.68, 0.65,
    0.62, 0.59, 0.56, 0.53, 0.49, 0.45, 0.42, 0.38, 0.34, 0.3, 0.25, 0.21, 0.16, 0.12, 0.07, 0.02, -0.04, -0.09, -0.14, -0.2,
    -0.26, -0.31, -0.37, -0.43, -0.5, -0.56, -0.63, -0.69, -0.76, -0.83, -0.9, -0.98, -1.05, -1.12, -1.2, -1.28, -1.36, -1.44, -1.52, -1.61,
]


def degree_year_score(difference: int) -> float:
    """Of a publication so many years after the degree, clamped to -99 and 100."""
    return DEGREE_SCORES[max(-99, min(100, difference)) + 99]


# How strongly a dimension's absence counts, and its scale.
ABSENCE = {
    "TargetAuthorName": 1.0, "CoAuthorName": 0.9, "Email": 0.3, "Journal": 0.7, "JournalSubField": 0.7, "Keyword": 0.9,
    "Institution": 0.5, "Organization": 0.5, "Orcid": 0.3, "OrcidCoAuthor": 0.0, "Cites": 0.5, "Year": 0.0,
}
ABSENCE_SCALE = 10.0

#: Dimensions with several values; of these the ones whose sum is divided by the number of values.
MULTI, AVERAGED = ("CoAuthorName", "Keyword", "OrcidCoAuthor"), ("CoAuthorName",)

# Words of institution names, and the sign of a place in an address.
STOPWORDS = ["of", "the", "for", "and", "to", "in", "at", "on", "a", "an"]
GENERIC_WORDS = [
    "university", "hospital", "center", "centre", "institute", "college", "school", "department", "division", "faculty",
    "program", "programme", "laboratory", "lab",
]
LOCATION = r"^\d{5}|USA$|^[A-Z]{2}$|^\d|United States|Canada|UK|China|Japan|Germany|France"


@dataclass
class Params:
    """What a site sets for itself."""

    lenient_threshold: int = 3000
    strict_threshold: int = 1500
    email_suffixes: list[str] = field(default_factory=list)
    home_keywords: list[str] = field(default_factory=list)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    high: float = 0.95
    unlikely: float = 0.30
