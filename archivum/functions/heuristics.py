"""What a path or a text looks like: categories, noise, grounded claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivum.functions.text import entropy, utf16_length

#: Path segments and the category that each stands for.
SEGMENTS = {
    "decisions": "decision", "adr": "decision", "adrs": "decision",
    "patterns": "pattern", "architecture": "pattern",
    "conventions": "convention", "standards": "convention",
    "troubleshooting": "troubleshooting", "debug": "troubleshooting", "debugging": "troubleshooting",
    "onboarding": "onboarding", "setup": "onboarding", "getting-started": "onboarding",
    "reference": "reference", "api": "reference", "apis": "reference",
}
#: Words that mark a licence, and titles that are none.
LICENCES = ["apache license", "mit license", "gnu general public license", "gnu lesser general public license", "mozilla public license", "permission is hereby granted, free of charge", "redistribution and use in source and binary forms"]
UNTITLED = ["untitled", "untitled document", "no title"]
LICENCE_CHARS, LONG_LINE, BLANK_SHARE, ENTROPY_CHARS, ENTROPY_BITS = 600, 1000, 0.1, 1024, 5.2
#: Words that negate, words of no content, and number words.
NEGATIONS = ["not", "never", "no", "none", "cannot", "cant", "dont", "doesnt", "isnt", "arent", "wont", "without", "non", "neither", "nor", "avoid", "avoids", "avoided", "avoiding"]
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "it", "its", "is", "are", "was", "were", "be",
    "been", "being", "to", "of", "in", "on", "at", "by", "for", "from", "with", "as", "into", "about", "between", "through", "so", "such", "can",
    "could", "should", "would", "may", "might", "must", "will", "shall", "do", "does", "did", "has", "have", "had", "he", "she", "they", "we", "you",
    "i", "their", "his", "her", "our", "your", "each", "every", "all", "any", "some", "both", "more", "most", "other", "own", "same", "which", "what",
    "when", "where", "while", "who", "whom", "how", "why", "also", "only", "very", "via", "per", "up", "out", "over", "under", "s", "t",
]
NUMBERS = {"zero": "0", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}


#: Prefixes that turn a word into its opposite, and the least
#: length of such a word; phrases that tell of something being gone.
OPPOSITES, OPPOSITE_CHARS = ["in", "un", "non"], 4
HISTORICAL = [
    "torn down", "tore down", "teardown", "decommission", "exodus", "migrated off", "migrated away", "moved off",
    "no longer use", "no longer used", "do not use", "don't use", "never use", "stopped using", "retired", "deprecated",
    "archived", "sunset", "no gcp", "not used", "fully exited", "exited", "wound down", "shut down",
    "removed", "legacy", "historical", "formerly", "used to", "superseded", "replaced by", "renamed to",
]


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])


def path_category(path: Column) -> Column:
    """Of the first segment that stands for one, else reference."""
    known = _map(SEGMENTS)
    found = F.filter(F.transform(F.split(F.lower(path), r"[/\\]"), lambda s: F.try_element_at(known, s)), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("reference"))


def path_title(path: Column) -> Column:
    """The base name without extension, blanks for - and _, words capitalised."""
    base = F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1"), "[-_]", " ")
    return F.array_join(F.transform(F.split(base, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def noise(content: Column, title: Column) -> Column:
    """untitled, license, minified or high-entropy, the first that applies."""
    head = F.lower(F.substring(content, 1, LICENCE_CHARS))
    licence = head.rlike("|".join(x.replace(".", r"\.") for x in LICENCES))
    thick = lambda x: (utf16_length(x) > LONG_LINE) & ((F.length(x) - F.length(F.regexp_replace(x, r"\s", ""))) / utf16_length(x) < BLANK_SHARE)
    coded = F.when(utf16_length(content) >= ENTROPY_CHARS, entropy(content) > ENTROPY_BITS)
    return F.when(F.lower(F.trim(title)).isin(UNTITLED), "untitled").when(licence, "license").when(F.exists(F.split(content, "\n"), thick), "minified").when(coded, "high-entropy")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _is_content(token: Column) -> Column:
    return ~token.isin([*STOPWORDS, *NEGATIONS, *NUMBERS]) & ~token.rlike(r"^\d+$")


def _variants(token: Column) -> Column:
    """The token and what it may be without a plural or verb ending."""
    n = F.length(token)
    cut = lambda k, tail="": F.concat(F.expr("''"), F.substring(token, F.lit(1), n - k), F.lit(tail))
    made = F.array(
        token,
        F.when((n > 3) & token.endswith("s") & ~token.endswith("ss"), cut(1)),
        F.when((n > 4) & token.endswith("es"), cut(2)),
        F.when((n > 4) & token.endswith("ed"), cut(2)),
        F.when((n > 4) & token.endswith("ed"), cut(2, "e")),
        F.when((n > 5) & token.endswith("ing"), cut(3)),
        F.when((n > 5) & token.endswith("ing"), cut(3, "e")),
    )
    return F.filter(made, lambda v: v.isNotNull())


def numbers(text: Column) -> Column:
    """Numbers, their parts, and number words as digits, each once."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(r"\d+(?:[./]\d+)*[a-z]?"), F.lit(0))
    known = _map(NUMBERS)
    named = F.filter(F.transform(_tokens(text), lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(whole, F.flatten(F.transform(whole, lambda m: F.split(m, "[./]"))), named))


def clauses(text: Column) -> Column:
    return F.split(text, r"[.,;:()!?…]|—|–|\s-\s|\n")


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once: what a lambda names is
    a variable, while an expression in it would be for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def negated(text: Column) -> Column:
    """The first content token after each negation, within its clause."""

    def after(tokens: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.coalesce(F.try_element_at(tokens, i).isin(NEGATIONS), F.lit(False)))
        first = F.transform(places, lambda i: F.try_element_at(F.filter(F.slice(tokens, i + 1, F.size(tokens)), _is_content), F.lit(1)))
        return F.filter(first, lambda t: t.isNotNull())

    return F.array_distinct(F.flatten(F.transform(F.transform(clauses(text), _tokens), after)))


def plain_terms(text: Column) -> Column:
    """Content tokens of the clauses that have no negation, each once."""
    tokens = F.transform(clauses(text), _tokens)
    free = F.filter(tokens, lambda t: ~F.arrays_overlap(t, F.array(*[F.lit(n) for n in NEGATIONS])))
    return F.array_distinct(F.filter(F.flatten(free), _is_content))


def support(claim: Column, excerpt: Column) -> Column:
    """Share of the claim's content tokens of which the excerpt has a variant;
    1 for a claim without any."""
    own = F.array_distinct(F.filter(_tokens(claim), _is_content))
    known = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.filter(_tokens(excerpt), _is_content)), _variants)))

    def share(both: Column) -> Column:
        held = F.filter(both["own"], lambda t: F.arrays_overlap(_variants(t), both["known"]))
        return F.when(F.size(both["own"]) == 0, 1.0).otherwise(F.size(held) / F.size(both["own"]))

    return let(F.struct(own.alias("own"), known.alias("known")), share)


def opposites(claim: Column, excerpt: Column) -> Column:
    """Words of one text of which the other has only the prefixed opposite;
    a word is passed over where its own text has that opposite too."""
    one, two = F.array_distinct(_tokens(claim)), F.array_distinct(_tokens(excerpt))

    def turned(words: Column) -> Column:
        """What the prefixed words are the opposites of."""

        def cut(prefix: str) -> Column:
            return F.transform(F.filter(words, lambda w: w.startswith(prefix)), lambda w: F.substring(w, len(prefix) + 1, 1 << 20))

        return F.flatten(F.array(*map(cut, OPPOSITES)))

    def against(own: Column, other: Column) -> Column:
        found = F.array_except(F.array_except(F.array_intersect(own, turned(other)), other), turned(own))
        return F.filter(found, lambda t: F.length(t) >= OPPOSITE_CHARS)

    return let(F.struct(one.alias("one"), two.alias("two")), lambda b: F.concat(against(b["one"], b["two"]), against(b["two"], b["one"])))


def historical(text: Column) -> Column:
    """Whether a text reads as a record of something being gone."""
    return F.lower(text).rlike("|".join(HISTORICAL))


def grounded(claim: Column, excerpt: Column, threshold: float = 0.7) -> Column:
    """Whether an excerpt supports a claim: no number of its own, the same
    negated terms among those that both mention, no word of one against its
    opposite in the other, and enough shared tokens."""
    new_numbers = F.size(F.array_except(numbers(claim), numbers(excerpt))) > 0
    both = F.array_intersect(F.array_distinct(_tokens(claim)), F.array_distinct(_tokens(excerpt)))
    one, two = negated(claim), negated(excerpt)
    flipped = F.size(F.array_intersect(F.concat(F.array_except(one, two), F.array_except(two, one)), both)) > 0
    return ~new_numbers & ~flipped & (F.size(opposites(claim, excerpt)) == 0) & (support(claim, excerpt) >= threshold)
