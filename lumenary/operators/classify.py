"""Tags, categories and pay benchmarks of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary import dims
from lumenary.dictionary import PAY, REMEMBERED, SUPPLIED, Dictionary, row_function
from lumenary.functions.money import half_up, percentile_in
from lumenary.functions.phrases import contains_any


def classify(jobs: DataFrame) -> DataFrame:
    """``jobs`` with sorted ``tags`` and a refined ``location_class``.

    Reads title, company, location, work_place, location_class (null: default_location_class) and
    default_tags. Word lists are literals, so the rule is a projection within the scan's stage.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    both, title = F.concat_ws(" ", low("location"), low("title"), low("company")), low("title")
    given = F.coalesce(F.nullif("location_class", F.lit("")), F.col("default_location_class"))
    home = contains_any(both, dims.HOME_WORDS)
    at_home = (F.col("work_place") == "REMOTE") | low("location").contains("remote")
    remote = contains_any(both, dims.REMOTE_WORDS) | F.coalesce(at_home, F.lit(False))
    first = F.when(home & given.isin("INTERNATIONAL_REMOTE", "INTERNATIONAL_ONSITE"), F.when(at_home, "ETHIOPIA_REMOTE").otherwise("ETHIOPIA_LOCAL")).otherwise(given)
    then = F.when(remote & home & first.contains("ETHIOPIA"), "ETHIOPIA_REMOTE").when(remote & ~home & first.contains("LOCAL"), "INTERNATIONAL_REMOTE").otherwise(first)
    tag = lambda test, name: F.when(test, name)
    found = F.array(
        tag(home, "ethiopian"),
        tag(remote, "remote"),
        tag(~home, "international"),
        tag(contains_any(both, dims.NGO_WORDS), "ngo"),
        tag(contains_any(title, dims.TECH_WORDS), "tech"),
        tag(contains_any(title, dims.SENIOR_WORDS), "senior"),
        tag(contains_any(title, dims.ENTRY_WORDS), "entry_level"),
        tag(contains_any(both, dims.FREELANCE_WORDS), "freelance"),
    )
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("default_tags", F.array().cast("array<string>")), F.array_compact(found))))
    return jobs.withColumns({"tags": tags, "location_class": then})


def map_categories(source: Column, labels: Column, title: Column, skills: Column, words: Dictionary = SUPPLIED) -> Column:
    """Categories by the source's catalogue, by alias, by keywords of the labels, and by keywords of title and skills; each once, in that order."""
    seen: dict[str, tuple] = {}

    def by_label(label: str) -> tuple:
        if label not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen[label] = words.by_label(label)
        return seen[label]

    return row_function(lambda *row: words.categories(*row, by_label), T.ArrayType(T.StringType()), source, labels, title, skills)


def valid_labels(source: Column, labels: Column, words: Dictionary = SUPPLIED) -> Column:
    """Labels that are ids of the source's catalogue; none for a source without one."""
    return row_function(words.valid_labels, T.ArrayType(T.StringType()), source, labels)


def benchmark(title: Column, level: Column, words: Dictionary = SUPPLIED) -> Column:
    """The pay benchmark of a title and level, as a struct: of the first role that the title contains, at the level or else at the role's first one."""
    return row_function(words.pay, PAY, title, level)


def compare_pay(amount: Column, currency: Column, bench: Column) -> dict[str, Column]:
    """percentile of an amount in its benchmark, percent above the median, and words for it; null without either."""
    local = currency == dims.LOCAL_CURRENCY
    of = lambda what: F.when(local, bench[f"local_{what}"]).otherwise(bench[f"foreign_{what}"])
    known = bench.isNotNull() & amount.isNotNull()
    at = F.when(known, percentile_in(amount, of("low"), of("high")))
    above = F.when(known & (of("mid") > 0), half_up((amount - of("mid")) / of("mid").cast("double") * 100))
    says = F.when(at >= 80, "above market").when(at >= 50, "at market").when(at >= 20, "below median").when(at >= 0, "well below market")
    return {"percentile": at, "percent_above": above, "comparison": says}
