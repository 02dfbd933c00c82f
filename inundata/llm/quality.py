"""Line-first quality rules, evaluated with built-in functions only.

Each line is judged by rules on its punctuation, on navigation and on boilerplate; failing lines
go, and a document that loses too much of its text goes with them. Whole-document counts
(words, symbols, repeated lines, repeated windows) are measured beside that. Lines aren't judged by
how many documents share them: a group of copies would make each of its own lines common, and clean
documents would go for having been copied. Shared lines are the work of line dedup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inundata.llm.text import let, lines, words

#: Fixed phrases of page furniture, matched in lower case: English, German, French, Spanish.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of service",
    "terms of use",
    "use of cookies",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "cookie-richtlinie",
    "datenschutzerklärung",
    "hier klicken",
    "javascript aktivieren",
    "klicken sie hier",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "verwendung von cookies",
    "zum inhalt springen",
    "abonnez-vous à notre newsletter",
    "activer javascript",
    "aller au contenu",
    "cliquez ici",
    "conditions d'utilisation",
    "conditions générales d",
    "mentions légales",
    "politique de confidentialité",
    "propulsé par",
    "tous droits réservés",
    "utilisation de cookies",
    "aviso legal",
    "habilitar javascript",
    "haga clic aquí",
    "política de cookies",
    "política de privacidad",
    "saltar al contenido",
    "suscríbase a nuestro boletín",
    "términos de servicio",
    "términos de uso",
    "todos los derechos reservados",
    "uso de cookies",
)


@dataclass(frozen=True)
class QualityParams:
    """Limits of the rules; shares are percentages."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: A line without end punctuation fails when it has fewer words than this.
    min_open_words: int = 4
    #: Words that end in doubled or decorative marks, as a share of a line's words.
    max_marked_percent: int = 30
    #: Separators standing alone or closing words, as a share of a line's words.
    max_separator_percent: int = 25
    #: Longer lines with a boilerplate phrase are prose about it.
    max_furniture_words: int = 40
    #: Largest share of a document's word characters that cleaning may take.
    max_lost_percent: int = 40


#: Fixed marks that decorate words when doubled.
MARKS = ("!!", "??", "**", "##", "$$", "%%", "&&")
#: Fixed separators of menus and breadcrumbs.
SEPARATORS = ("|", "<", ">", "»", "«", "›", "•", "·")


def repeated_window_words(tokens: Column, window: int) -> Column:
    """Words covered by ``window``-word windows (a power of two) that occur twice or more.

    Window hashes come from hashes of half the width. Texts whose half windows are all
    distinct, most texts, are done after that.
    """

    def doubled(half: Column, step: int) -> Column:
        joined = F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + step)))
        return F.slice(joined, 1, F.greatest(F.size(half) - step, F.lit(0)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        return F.aggregate(
            let(placed, starts),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(window), i - a["last"])).cast("long").alias("n"), i.alias("last")
            ),
            lambda a: a["n"],
        )

    def from_halves(half: Column, width: int) -> Column:
        last = width == window
        body = covered(half) if last else let(doubled(half, width), lambda h: from_halves(h, 2 * width))
        return F.when(F.size(F.array_distinct(half)) == F.size(half), F.lit(0).cast("long")).otherwise(body)

    single = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < window, F.lit(0).cast("long")).otherwise(let(single, lambda h: from_halves(h, 1)))


def line_fails(line: Column, p: QualityParams) -> Column:
    """Whether one line is decoration, navigation or boilerplate; blank lines pass.

    The costly counts stand behind cheap tests that most lines don't pass.
    """

    def any_of(value: Column, parts: tuple[str, ...]) -> Column:
        found = F.contains(value, F.lit(parts[0]))
        for part in parts[1:]:
            found = found | F.contains(value, F.lit(part))
        return found

    n = F.size(words(line))
    space, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    open_and_short = (
        rf"^{space}*(?:{other}+{space}+){{0,{p.min_open_words - 2}}}{other}*[^\x20\x09-\x0D\p{{Po}}\p{{Pf}}\p{{Pe}}\"']{space}*$"
    )
    marked = F.regexp_count(line, F.lit(r"(?:!!|\?\?|\*\*|##|\$\$|%%|&&)[.,]*(?=[\x20\x09-\x0D]|$)"))
    separators = F.regexp_count(line, F.lit(r"[|<>»«›•·](?=[\x20\x09-\x0D]|$)"))
    return (
        line.rlike(open_and_short)
        | (any_of(line, MARKS) & (marked * 100 > n * p.max_marked_percent))
        | (any_of(line, SEPARATORS) & (separators * 100 > n * p.max_separator_percent))
        | let(F.lower(line), lambda low: any_of(low, BOILERPLATE) & (n < p.max_furniture_words))
    )


def quality_struct(text: Column, p: QualityParams = QualityParams()) -> Column:
    """One struct per document with every measure, the verdicts and the cleaned text."""
    whole = F.coalesce(text, F.lit(""))

    def measured(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("chars"),
            repeated_window_words(tokens, p.window).alias("repeats"),
        )

    def by_line(every: Column) -> Column:
        worded = F.filter(every, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        kept = F.filter(every, lambda x: ~line_fails(x, p))
        return F.struct(
            let(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("long")).alias("dups"),
            let(
                kept,
                lambda k: F.when(F.size(k) == F.size(every), F.struct(F.lit(0).cast("long").alias("lost"), whole.alias("text")))
                .otherwise(
                    F.struct(
                        (F.length(F.array_join(words(whole), "")) - F.length(F.array_join(words(F.array_join(k, " ")), ""))).cast("long").alias("lost"),
                        F.array_join(k, "\n").alias("text"),
                    )
                ),
            ).alias("clean"),
        )

    def verdict(m: Column, ln: Column) -> Column:
        failed = (m["n_words"] < p.min_words) | (100 * m["repeats"] > p.max_repeat_percent * m["n_words"])
        return F.struct(
            m["n_words"].alias("n_words"),
            m["chars"].alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            ln["dups"].alias("n_dup_lines"),
            m["repeats"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            ln["clean"]["lost"].alias("lost_chars"),
            (~failed & (100 * ln["clean"]["lost"] <= p.max_lost_percent * m["chars"])).alias("kept"),
            ln["clean"]["text"].alias("clean_text"),
        )

    return let(let(words(text), measured), lambda m: let(let(lines(text), by_line), lambda ln: verdict(m, ln)))


def apply_quality_rules(docs: DataFrame, text: str = "text", p: QualityParams = QualityParams()) -> DataFrame:
    """``row`` (all input columns, whatever their names) and ``quality`` (see :func:`quality_struct`).

    Null and empty texts have zero counts and fail for want of words; repeated rows are judged
    alike, each for itself; an empty table gives an empty table. Nothing is shuffled. A very long
    text is judged whole, in its row; texts that reach a limit exactly are kept.
    """
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), quality_struct(docs[text], p).alias("quality"))
