"""Column functions: tokens, ordered rules, formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters in any script, the same for Spark and for DuckDB.
WORD = r"[\p{L}\p{N}_]+"


#: Words that say nothing of a text's subject.
STOP_WORDS = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь
опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь
этом один почти мой тем чтобы нее были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой
перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
the and for with that this was were are from have has had not but all can may its our their these those there than then when which who whom been being into over under more most such some any each both
between during after before while about against among also however although therefore thus study studies results conclusion conclusions background methods objective aim significant significantly associated
compared using used based
""".split()


def words(text: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD[:-1]}{{{least},}}"), F.lit(0))


def tokens(text: Column, least: int = 3, cut: int = 6) -> Column:
    """Words of at least so many characters that are no stop words, cut to a stem."""
    stop = [w for w in STOP_WORDS if len(w) >= least]
    return F.transform(F.filter(words(text, least), lambda w: ~w.isin(stop)), lambda w: F.substring(w, 1, cut))


#: Endings that a stem loses, the longest that fits first; letters that a stem keeps at least.
ENDINGS, LEAST_STEM = "ational ization iveness fulness ousness ations ities ively ement ation ingly edly ism ness ment ity ies ing ers ive al ic ed es s".split(), 4


def stems(text: Column) -> Column:
    """Words of three letters or more without their English ending, then without a last e."""
    bare = lambda w: F.regexp_replace(w, f"^(.{{{LEAST_STEM},}}?)(?:{'|'.join(ENDINGS)})$", "$1")
    return F.transform(F.filter(words(text), lambda w: F.length(w) > 2), lambda w: F.regexp_replace(bare(w), f"^(.{{{LEAST_STEM},}})e$", "$1"))


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The value of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules], F.lit(otherwise))


def bmr(male: Column, kg: Column, cm: Column, years: Column) -> Column:
    """Resting energy by Mifflin and St Jeor."""
    return 10 * kg + 6.25 * cm - 5 * years + F.when(male, 5.0).otherwise(-161.0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
