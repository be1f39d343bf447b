"""The text pipeline as Column -> Column functions; everything stays in JVM code generation, without Python UDFs.

All functions give null for null, and keep the empty text as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordtide.functions import patterns as P


def strip_payload(desc: Column) -> Column:
    """Removes the first corrupt payload: from its marker to the end of that line. Later payloads stay."""
    # Greedy would reach the last marker; the lazy prefix stops at the first one.
    first = F.regexp_replace(desc, rf"(?s)\A(.*?){P.PAYLOAD_LINE}", "$1")
    return F.when(F.contains(desc, F.lit(P.PAYLOAD_MARKER)), first).otherwise(desc)


def strip_payloads(desc: Column) -> Column:
    """Removes every corrupt payload, each to the end of its line."""
    return F.when(F.contains(desc, F.lit(P.PAYLOAD_MARKER)), F.regexp_replace(desc, P.PAYLOAD_LINE, "")).otherwise(desc)


def strip_payload_to_end(desc: Column) -> Column:
    """Cuts the text at the first payload marker, following lines included."""
    return F.substring_index(desc, P.PAYLOAD_MARKER, 1)


def ascii_fold(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would also change other scripts."""
    return F.translate(text, P.ASCII_UPPER, P.ASCII_LOWER)


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(mark)) for mark in marks))


def has_entities(folded: Column) -> Column:
    """Whether the clean pattern can match at all; a cheap test that loses nothing."""
    return _any(folded, P.GATE)


def remove_entities(folded: Column) -> Column:
    """URLs, emails, mentions and hashtags become one space each; the leftmost alternative wins.

    The pattern holds only the alternatives that the text can match: most short texts have tags and nothing else, for
    which each position is tested against two characters instead of all alternatives.
    """
    links = _any(folded, tuple(m for m in P.GATE if m not in "@#"))
    mails = F.contains(folded, F.lit("@")) & folded.rlike(P.MAIL_CORE)
    without = lambda *patterns: F.regexp_replace(folded, "|".join(patterns), " ")
    return (
        F.when(links & mails, without(P.URL_JVM, P.EMAIL_JVM, P.TAG_JVM))
        .when(links, without(P.URL_JVM, P.TAG_JVM))
        .when(mails, without(P.EMAIL_JVM, P.TAG_JVM))
        .when(_any(folded, ("@", "#")), without(P.TAG_JVM))
        .otherwise(folded)
    )


def clean(desc: Column) -> Column:
    """Payload, then ASCII fold, then entities."""
    return remove_entities(ascii_fold(strip_payload(desc)))


def clean_sequential(desc: Column) -> Column:
    """The same removals as one pass per kind of entity, all payloads included; differs where one entity lies inside another,
    and after a second payload. Texts without a mark of any kind meet no pass."""
    folded = ascii_fold(strip_payloads(desc))
    text = folded
    for pattern in (P.URL_SCHEME, P.URL_BARE, P.EMAIL_JVM, P.MENTION, P.HASHTAG):
        text = F.regexp_replace(text, pattern, " ")
    return F.when(has_entities(folded), text).otherwise(folded)


def clean_to_end(desc: Column) -> Column:
    """The fused cleaner on a text that is cut at its first payload."""
    return remove_entities(ascii_fold(strip_payload_to_end(desc)))


def words(cleaned: Column) -> Column:
    """All words in order, repetitions kept."""
    return F.regexp_extract_all(cleaned, F.lit(P.WORD), F.lit(0))


def tokenize(desc: Column) -> Column:
    return words(clean(desc))


def distinct_words(desc: Column) -> Column:
    return F.array_distinct(tokenize(desc))


def signature(tokens: Column) -> Column:
    """Sorted distinct words joined by U+001F."""
    return F.array_join(F.sort_array(F.array_distinct(tokens)), "\x1f")


_LINK_MARKS = tuple(m for m in P.GATE if m not in "@#")


def emails(text: Column) -> Column:
    return _matches(text, ("@",), text, P.EMAIL_JVM)


def _matches(text: Column, marks: tuple[str, ...], rest: Column, pattern: str) -> Column:
    """All matches of a pattern in ``rest``, which is the text or what is left of it, if the text has one of the marks."""
    found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
    return F.when(text.isNull(), None).when(_any(text, marks), found).otherwise(F.array().cast("array<string>"))


def _without(text: Column, marks: tuple[str, ...], rest: Column, pattern: str) -> Column:
    return F.when(_any(text, marks), F.regexp_replace(rest, pattern, " ")).otherwise(rest)


def _no_mail(text: Column) -> Column:
    return _without(text, ("@",), text, P.EMAIL_JVM)


def _no_link(text: Column) -> Column:
    return _without(text, _LINK_MARKS, _no_mail(text), P.URL_JVM)


def _tidy_link(link: Column) -> Column:
    """Drops the boundary character that the match consumed, trailing punctuation, and trailing brackets that close nothing."""
    bare = F.regexp_replace(link, r"\A[^\p{IsAlphabetic}\p{IsDigit}_]", "")
    return F.when(bare.rlike(rf"[)\]}}][{P.LINK_TRAIL})\]}}]*\z"), _balanced(bare)).otherwise(F.rtrim(bare, F.lit(P.LINK_TRAIL)))


def _balanced(link: Column) -> Column:
    """Cuts from the end, sign by sign: punctuation, and closing brackets while there are more than opening ones."""
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign)))

    def cut(text: Column, _: Column) -> Column:
        last = F.right(text, F.lit(1))
        closes = reduce(lambda a, b: a | b, ((last == F.lit(b)) & (count(text, a) < count(text, b)) for a, b in ("()", "[]", "{}")))
        goes = closes | F.contains(F.lit(P.LINK_TRAIL), last) & (last != "")
        return F.when(goes, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)

    tail = F.regexp_extract(link, rf"[{P.LINK_TRAIL})\]}}]*\z", 0)
    return F.aggregate(F.sequence(F.lit(1), F.length(tail)), link, cut)


def urls(text: Column) -> Column:
    """Links after emails are taken out."""
    return F.transform(_matches(text, _LINK_MARKS, _no_mail(text), P.URL_JVM), _tidy_link)


def mentions(text: Column) -> Column:
    """Mentions after emails and links are taken out."""
    return _matches(text, ("@",), _no_link(text), P.MENTION)


def hashtags(text: Column) -> Column:
    """Hashtags after emails, links and mentions are taken out."""
    return _matches(text, ("#",), _without(text, ("@",), _no_link(text), P.MENTION), P.HASHTAG)
