"""Queries with the other-language words of their terms, for a whole column of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for letters that a longer form has taken.
_TAKEN = "\x00"


def forms(terms: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """Every form with the words of the other side, longest first (T3); forms of one length stay in their order.

    ``terms``: a term → its words. Both the term and each of its words are forms.
    """
    latin = lambda w: w.isascii()
    found = []
    for term, words in terms.items():
        names = [term, *words]
        sides = [w for w in names if latin(w)], [w for w in names if not latin(w)]
        found += [(f, sides[0]) for f in sides[1]] + [(f, sides[1]) for f in sides[0]]
    return sorted((f for f in found if f[0] and f[1]), key=lambda f: -len(f[0]))


def added_words(text: Column, glossary: list[tuple[str, list[str]]], most: int = 16) -> Column:
    """array<string>: the words that a text's terms add, in the order of forms.

    ``glossary``: forms as ``forms`` gives them, or any (form, words) in the order in which they take letters: the first place of a form whose letters
    no form before has taken is its own. Latin forms are found in any case, others as they are. A word that the text or an added word already is
    isn't added. No form is tried once ``most`` words are there. NULL and blank texts add nothing. The glossary is a bounded
    parameter that lives in the plan; only forms that a text holds are looked at further.
    """
    text = F.coalesce(text, F.lit(""))
    # A-Z only, so that places are the same in both
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = F.array(*(F.struct(F.lit(f.lower() if f.isascii() else f).alias("form"), F.lit(f.isascii()).alias("latin"), F.array(*map(F.lit, words)).alias("words")) for f, words in glossary if f))
    start = F.struct(low.alias("low"), text.alias("whole"), F.array().cast("array<string>").alias("added"))

    def add(state: Column, entry: Column) -> Column:
        at = F.position(entry["form"], F.when(entry["latin"], state["low"]).otherwise(state["whole"]))
        size = F.length(entry["form"])
        taken = lambda s: F.overlay(s, F.repeat(F.lit(_TAKEN), size), at, size)
        present = lambda words, w: F.contains(low, F.lower(w)) | F.exists(words, lambda a: F.lower(a) == F.lower(w))
        more = F.aggregate(entry["words"], state["added"], lambda words, w: F.when(present(words, w), words).otherwise(F.concat(words, F.array(w))))
        next_state = F.struct(taken(state["low"]).alias("low"), taken(state["whole"]).alias("whole"), more.alias("added"))
        return F.when((at > 0) & (F.size(state["added"]) < most), next_state).otherwise(state)

    if not any(f for f, _ in glossary):
        return F.array().cast("array<string>")
    held = F.filter(table, lambda e: F.contains(F.when(e["latin"], low).otherwise(text), e["form"]))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.aggregate(held, start, add)["added"])


def expanded(text: Column, glossary: list[tuple[str, list[str]]], most: int = 16) -> Column:
    """The text and the words it adds."""
    return F.array_join(F.concat(F.array(F.coalesce(text, F.lit(""))), added_words(text, glossary, most)), " ")
