"""Domains, weights and limits of the address engine. Fixed values, set by the data model."""

from __future__ import annotations

from dataclasses import dataclass

TAGS = ("OTHER", "COUNTRY", "TOWN", "STREET", "POSTAL_CODE", "CONTINENT", "GENERIC_WORD", "NATURAL_PERSON_NAME", "FINANCIAL_INSTITUTION", "BUSINESS_ENTITY_NAME", "BUSINESS_ENTITY_TYPE", "MONTH", "YEAR", "IBAN", "FLOAT", "INTEGER", "ALPHANUMERIC", "CURRENCY", "FINANCIAL_JARGON", "SEPARATOR", "HOUSE_NUMBER", "DATE", "SPECIFIER", "PHONE_NUMBER")

NO_COUNTRY, NO_TOWN = "NO COUNTRY", "NO TOWN"
NIL = ("", "nil", "null", "none", "n/a", "na")

#: Score weights of flags by side. A flag that a side lacks has no weight there.
TOWN_WEIGHTS = {
    "IS_INSIDE_ANOTHER_WORD": -0.65, "IS_METROPOLIS": 0.10, "IS_SMALL_TOWN": -0.20, "IS_NOT_LARGEST_TOWN_WITH_NAME": -0.10, "IS_INSIDE_STREET": -0.20, "IS_ALONE_ON_LINE": 0.20,
    "IS_COMMON_STATE_PROVINCE_ALIAS": -0.10, "IS_UNCOMMON_STATE_PROVINCE_ALIAS": -0.15, "COUNTRY_IS_PRESENT": 0.15, "SUGGESTED_COUNTRY_IS_PRESENT": 0.65, "IS_VERY_CLOSE_TO_COUNTRY": 0.30, "IS_ON_SAME_LINE_AS_COUNTRY": 0.15,
    "MLP_COUNTRY_IS_PRESENT": 0.05, "COULD_BE_REASONABLE_MISTAKE": 0.25, "IS_INSIDE_ANOTHER_LOWER_RANKED_MATCH": -0.30, "IS_INSIDE_ANOTHER_HIGHER_RANKED_MATCH": -2.00, "IS_SHORT": -0.25, "IS_IN_FIRST_THIRD": -0.01, "IS_IN_LAST_THIRD": 0.01,
    "IS_FROM_EXTENDED_DATA": -0.15, "POSTCODE_FOR_TOWN_FOUND": 0.40,
}
COUNTRY_WEIGHTS = {
    "IS_INSIDE_ANOTHER_WORD": -0.60, "IS_INSIDE_STREET": -0.20, "IBAN_IS_PRESENT": 0.10, "IS_COMMON_STATE_PROVINCE_ALIAS": -0.10, "IS_UNCOMMON_STATE_PROVINCE_ALIAS": -0.15, "MLP_STRONGLY_AGREES": 0.20, "MLP_AGREES": 0.15, "MLP_DOESNT_DISAGREE": 0.05,
    "PHONE_PREFIX_IS_PRESENT": 0.10, "DOMAIN_IS_PRESENT": 0.10, "POSTAL_CODE_IS_PRESENT": 0.10, "TOWN_IS_PRESENT": 0.20, "IS_VERY_CLOSE_TO_TOWN": 0.20, "IS_ON_SAME_LINE_AS_TOWN": 0.10, "COULD_BE_REASONABLE_MISTAKE": 0.10,
    "IS_INSIDE_ANOTHER_LOWER_RANKED_MATCH": -0.30, "IS_INSIDE_ANOTHER_HIGHER_RANKED_MATCH": -2.00, "IS_SHORT": -0.05, "IS_IN_FIRST_THIRD": -0.01, "IS_IN_LAST_THIRD": 0.01,
}
#: The weight of an edit, and further terms of combined flags.
TYPO = {"town": -0.85, "country": -0.50}
SHORT_TYPO, SHORT_INSIDE, SMALL_WITHOUT_COUNTRY, COUNTRY_MISSING = -2.0, -2.0, -0.30, 0.10

COMMON_PROVINCE_ORIGINS = ("CN", "US")
IBAN = r"([A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){1,7})"
#: Optional endings of postal codes by country.
POSTCODE_SUFFIX = {"AR": "[0-9]{4}", "BR": "[0-9]{3}", "CL": "[0-9]{4}", "CN": "[0-9]{2}", "IE": "(?:[a-zA-Z][0-9][a-zA-Z][0-9]|[a-zA-Z]{2}[0-9]{2}|[a-zA-Z][0-9][a-zA-Z]{2})", "MT": "[0-9]{4}"}

SOURCES = ("human_verified", "crf_pipeline", "sonnet_seed", "llm_assisted")


@dataclass(frozen=True)
class Limits:
    """Defaults of the whole engine."""

    max_length: int = 224
    cutoff: int = 80
    tolerance: int = 1
    country_least: float = 0.15
    town_least: float = 0.15
    suggested_score: float = 0.95
    metropolis: int = 1_000_000
    small_town: int = 12_000
    close: int = 15
    street_share: float = 0.5
    high: float = 0.95
    medium: float = 0.80
    review: float = 0.85
    semantic: float = 0.90
    lexical: float = 0.85
    neighbours: int = 5
    trust_seed: bool = False
    trust_assisted: bool = False


LIMITS = Limits()


def thresholds(high: float = 0.0, medium: float = 0.0) -> tuple[float, float]:
    """Quality thresholds: non-positive ones take the defaults, medium is capped at high."""
    high = high if high > 0 else LIMITS.high
    medium = medium if medium > 0 else LIMITS.medium
    return high, min(high, medium)
