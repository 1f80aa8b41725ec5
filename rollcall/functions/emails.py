"""E-mail expressions. The three cohort rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.fixed_values import PERSONAL_DOMAINS
from rollcall.functions.text import first_filled, text, trim_all


def email_key(email: Column) -> Column:
    return F.lower(trim_all(email))


def _after_at(email: Column) -> Column:
    """Everything after the first @ of the cleaned address."""
    return F.when(F.contains(email, F.lit("@")), F.regexp_replace(email, "^[^@]*@", "")).otherwise("")


def signal_domain(email: Column) -> Column:
    return _after_at(email_key(email))


def signal_cohort(email: Column) -> Column:
    """personal / edu / gov / org / corp / no_email, counting British and Australian hosts."""
    domain = signal_domain(email)
    return (
        F.when(domain == "", "no_email")
        .when(domain.isin(PERSONAL_DOMAINS), "personal")
        .when(domain.rlike(r"(\.edu|\.ac\.uk|\.edu\.au)$"), "edu")
        .when(domain.rlike(r"(\.gov|\.gov\.uk)$"), "gov")
        .when(F.endswith(domain, F.lit(".org")), "org")
        .otherwise("corp")
    )


def org_domain(email: Column) -> Column:
    """Domain of an organisation's address; empty for personal and missing addresses."""
    domain = signal_domain(email)
    return F.when(domain.isin(PERSONAL_DOMAINS), "").otherwise(domain)


def email_local(email: Column) -> Column:
    cleaned = email_key(email)
    return F.when(F.contains(cleaned, F.lit("@")), F.regexp_extract(cleaned, "^([^@]*)@", 1)).otherwise("")


def report_email_type(email: Column) -> Column:
    """Rule of the coverage report: knows ``malformed``, ignores national academic hosts."""
    domain = signal_domain(email)
    return (
        F.when(text(email) == "", "no_email")
        .when(domain == "", "malformed")
        .when(domain.isin(PERSONAL_DOMAINS), "personal")
        .when(F.endswith(domain, F.lit(".edu")), "edu")
        .when(F.endswith(domain, F.lit(".gov")), "gov")
        .when(F.endswith(domain, F.lit(".org")), "org")
        .otherwise("corp")
    )


def sampler_cohort(email: Column, organization: Column) -> Column:
    """Rule of the ground-truth sampler: no ``org`` class, joined with an organisation flag."""
    address = F.lower(text(email))
    domain = _after_at(address)
    kind = (
        F.when(address == "", "no_email")
        .when(domain.isin(PERSONAL_DOMAINS), "personal")
        .when(F.endswith(domain, F.lit(".edu")), "edu")
        .when(F.endswith(domain, F.lit(".gov")), "gov")
        .otherwise("corp")
    )
    return F.concat(kind, F.when(trim_all(organization) == "", "+noorg").otherwise("+org"))


def company_stem(domain: Column) -> Column:
    """Likely company word of a domain, with mailbox words taken out."""
    stem = F.split_part(text(domain), F.lit("."), F.lit(1))
    cleaned = F.regexp_replace(stem, "(mail|email|info|contact|admin|support)", "")
    return first_filled(trim_all(cleaned), stem)


def base_domain(email: Column) -> Column:
    """Last two labels of the address's domain."""
    return F.regexp_extract(_after_at(F.lower(text(email))), r"([^.]+\.[^.]+|[^.]+)$", 1)
