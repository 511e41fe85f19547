"""Text search: keyword queries and dictionaries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.stemming import stem
from millrace.registry import Operator, PropertyError, col, new_name, operator, wire

# One token: a run of letters, digits and marks, joined by an apostrophe or dot between letters, by a dot or comma
# between digits, by underscores; each Han, Hiragana character is a token of its own. It has a letter or digit.
_SINGLE = r"[\p{IsHan}\p{IsHiragana}]"
_CHAR = r"[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]"
TOKEN = rf"{_SINGLE}\p{{M}}*|{_CHAR}+(?:(?:(?<=\p{{L}})['’.:](?=\p{{L}})|(?<=\p{{N}})[.,'](?=\p{{N}})){_CHAR}+)*"


def tokens(text: Column) -> Column:
    """Lower-case word tokens of a text, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: t.rlike(r"[\p{L}\p{N}]"))


# The signs of the classic query syntax of full-text engines.
_LEXER = re.compile(
    r"""[\s\u3000]*(?:
    (?P<and>AND(?![^\s()"])|&&) | (?P<or>OR(?![^\s()"])|\|\|) | (?P<not>NOT(?![^\s()"])|!) | (?P<open>\() | (?P<close>\)) | (?P<sign>[+-]) |
    (?P<boost>\^[0-9]+(?:\.[0-9]+)?) | (?P<fuzzy>~[0-9]*(?:\.[0-9]+)?) | (?P<colon>:) |
    "(?P<phrase>(?:[^"\\]|\\.)*)" | /(?P<regex>(?:[^/\\]|\\.)*)/ |
    (?P<range>[\[{]\s*(?:"(?:[^"\\]|\\.)*"|[^\s\]}]+)\s+TO\s+(?:"(?:[^"\\]|\\.)*"|[^\s\]}]+)\s*[\]}]) |
    (?P<word>(?:[^\s\u3000+\-!():^\[\]"{}~\\/]|\\.)(?:[^\s\u3000!():^\[\]"{}~\\/]|\\.)*))""",
    re.X | re.S,
)
_RANGE = re.compile(r"([\[{])\s*(\"(?:[^\"\\]|\\.)*\"|\S+)\s+TO\s+(\"(?:[^\"\\]|\\.)*\"|[^\s\]}]+)\s*([\]}])", re.S)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Clause(NamedTuple):
    """Part of a query: whether it matches, whether it adds to the score (a boost of 0 doesn't), given a text's tokens with
    a space around each; and what a lower-case text must hold for a match (None: nothing is known)."""

    test: Callable[[Column], Column]
    score: Callable[[Column], Column]
    needs: Callable[[Column], Column] | None = None


def _clause(test: Callable[[Column], Column], needs: Callable[[Column], Column] | None = None) -> Clause:
    return Clause(test, test, needs)


def _some_token(test: Callable[[Column], Column]) -> Clause:
    return _clause(lambda j: F.exists(F.split(F.trim(j), " "), test))


def _joined(parts: list, how: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda x: reduce(how, (p(x) for p in parts))


def _any(clauses: list[Clause]) -> Clause:
    either = lambda a, b: a | b
    needs = [c.needs for c in clauses]
    return Clause(_joined([c.test for c in clauses], either), _joined([c.score for c in clauses], either), None if None in needs else _joined(needs, either))


def _words(text: str, phrase: bool, slop: int = 0) -> Clause | None:
    """The tokens of a text: any of them, or as a phrase all in a row, moved by up to slop places; None without a token."""
    words = split_words(text)
    if not words:
        return None
    holds = [lambda t, w=w: t.contains(w) for w in words]
    if len(words) > 1 and not phrase:
        return _any([_words(w, False) or _clause(lambda j: F.lit(False)) for w in words])
    if slop == 0 or len(words) == 1:
        row = f" {' '.join(words)} "
        return _clause(lambda j: j.contains(row), _joined(holds, lambda a, b: a & b))

    def near(j: Column) -> Column:
        # A place b such that each word k has an occurrence from b + k to b + k + slop; a token has a space before and behind.
        return F.exists(
            F.array(F.split(F.trim(j), " ")),
            lambda t: F.exists(
                F.sequence(F.lit(1 - slop - len(words)), F.size(t)),
                lambda b: reduce(lambda x, y: x & y, (F.array_contains(F.slice(t, F.greatest(b + k, F.lit(0)) + 1, F.greatest(b + k + slop - F.greatest(b + k, F.lit(0)) + 1, F.lit(0))), w) for k, w in enumerate(words))),
            ),
        )

    return _clause(near, _joined(holds, lambda a, b: a & b))


def _fuzzy(word: str, edits: int) -> Clause:
    """A token within so many edits (insert, delete, replace, swap two neighbours)."""
    if not edits:
        return _clause(lambda j: j.contains(f" {word} "))
    swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})

    def close(x: Column) -> Column:
        near = F.levenshtein(x, F.lit(word), edits) >= 0
        for s in swaps:
            near |= (x == s) if edits == 1 else (F.levenshtein(x, F.lit(s), edits - 1) >= 0)
        return near

    return _some_token(close)


class _Query:
    """Recursive descent over a query in the classic syntax; single() and clauses() give a Clause, or None if it has no token."""

    def __init__(self, text: str, field: str):
        self.items, at, self.field = [], 0, field
        while at < len(text.rstrip()):
            m = _LEXER.match(text, at)
            if not m:
                raise PropertyError(f"KeywordSearch: can't read {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.items[self.at + ahead][0] if self.at + ahead < len(self.items) else None

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.items[self.at - 1]

    def clauses(self, field: str) -> Clause | None:
        """Clauses up to a closing bracket: each must, should or mustn't match."""
        found: list[list] = []
        joined, opened = None, self.at
        while (kind := self.peek()) not in (None, "close"):
            if kind in ("and", "or"):
                if joined or self.at == opened:
                    raise PropertyError("KeywordSearch: AND or OR without a clause before it")
                self.next()
                joined = kind
                continue
            how = "should"
            if kind in ("sign", "not"):
                how = "must" if self.next()[1] == "+" else "not"
            clause = self.boosted(field)
            if joined == "and":
                if found and found[-1][0] == "should":
                    found[-1][0] = "must"
                if how == "should":
                    how = "must"
            joined = None
            if clause is not None:
                found.append([how, clause])
        if joined:
            raise PropertyError("KeywordSearch: AND or OR without a clause behind it")
        must, should, never = ([c for w, c in found if w == h] for h in ("must", "should", "not"))
        if not found:
            return None
        if not must and not should:
            return _clause(lambda j: F.lit(False))  # exclusions alone find nothing
        if must:
            needs = [c.needs for c in must if c.needs]
            good = Clause(_joined([c.test for c in must], lambda a, b: a & b), _any(must + should).score, _joined(needs, lambda a, b: a & b) if needs else None)
        else:
            good = _any(should)
        if never:
            bad = _any(never).test
            return Clause(lambda j: good.test(j) & ~bad(j), lambda j: good.test(j) & good.score(j) & ~bad(j), good.needs)
        return Clause(good.test, lambda j: good.test(j) & good.score(j), good.needs)

    def boosted(self, field: str) -> Clause | None:
        if self.peek() == "word" and self.peek(1) == "colon":
            field = _plain(self.next()[1])
            self.next()
        clause = self.single(field)
        if self.peek() == "boost":
            zero = float(self.next()[1][1:]) == 0
            if clause is not None and zero:
                return clause._replace(score=lambda j: F.lit(False))
        return clause

    def number(self) -> str | None:
        """What follows a ~ after a word or a phrase; None without one."""
        return self.next()[1][1:] if self.peek() == "fuzzy" else None

    def single(self, field: str) -> Clause | None:
        if self.peek() is None:
            raise PropertyError("KeywordSearch: nothing to look for before the end")
        kind, text = self.next()
        if kind == "open":
            inner = self.clauses(field)
            if self.peek() != "close":
                raise PropertyError("KeywordSearch: a bracket isn't closed")
            self.next()
            return inner
        if kind == "phrase":
            slop = self.number()
            return self.of(field, _words(_plain(text), True, int(float(slop)) if slop else 0))
        if kind == "range":
            return self.of(field, self.between(text))
        if kind == "regex":
            if re.search(r"(?<!\\)[~#@&<>]", text):
                raise PropertyError(f"KeywordSearch: /{text}/ uses signs that only some engines' expressions have")
            return self.of(field, _some_token(lambda x: x.rlike(f"^(?:{text})$")))
        if kind != "word":
            raise PropertyError(f"KeywordSearch: nothing to look for before {text!r}")
        fuzzy = self.number()
        if re.search(r"(?<!\\)[*?]", text):
            if field == "*" and text == "*":
                return _clause(lambda j: F.lit(True))
            pattern = "".join({"*": "[^ ]*", "?": "[^ ]"}.get(part, re.escape(_plain(part).lower())) for part in re.findall(r"\\.|.", text, re.S))
            return self.of(field, _clause(lambda j: j.rlike(f" {pattern} ")))
        if fuzzy is not None:
            word, least = _plain(text).lower(), float(fuzzy or 2)
            edits = min(int(least), 2) if least >= 1 else 0 if least == 0 else min(int((1 - least) * len(word)), 2)
            return self.of(field, _fuzzy(word, edits))
        return self.of(field, _words(_plain(text), False))

    def of(self, field: str, clause: Clause | None) -> Clause | None:
        """The clause, if its field is the one that is searched; there are no others."""
        return clause if field == self.field or clause is None else _clause(lambda j: F.lit(False))

    def between(self, text: str) -> Clause:
        """A token from one to another, square brackets with the ends, * without an end."""
        left, low, high, right = _RANGE.fullmatch(text).groups()
        low, high = (None if x == "*" else _plain(x[1:-1] if x[:1] == '"' else x).lower() for x in (low, high))

        def inside(x: Column) -> Column:
            test = F.length(x) > 0
            if low is not None:
                test &= (x >= low) if left == "[" else (x > low)
            if high is not None:
                test &= (x <= high) if right == "]" else (x < high)
            return test

        return _some_token(inside)


def split_words(text: str) -> list[str]:
    """The tokens of a text on the driver, by the same rule as tokens()."""
    import regex

    char = r"[[\p{L}\p{M}\p{N}_]--[\p{Han}\p{Hiragana}]]"
    token = rf"(?V1)[\p{{Han}}\p{{Hiragana}}]\p{{M}}*|{char}+(?:(?:(?<=\p{{L}})['’.:](?=\p{{L}})|(?<=\p{{N}})[.,'](?=\p{{N}})){char}+)*"
    return [t for t in regex.findall(token, text.lower()) if regex.search(r"[\p{L}\p{N}]", t)]


def keyword_test(query: str, text: Column, field: str) -> Column:
    """Whether a text matches a query in the classic syntax of full-text engines.

    Terms (any of them), AND, OR, NOT, +, -, brackets, "phrases" (with ~n: moved by n places), wildcards, ~n fuzzy terms,
    ranges, /expressions/, ^boosts (of which only 0 counts), and fields (`field`; others match nothing). Words of a
    text are whole and without case; a null matches nothing, nor does a query without words. A text is cut into tokens
    once, and only if it holds the words that the query can't do without.
    """
    parser = _Query(query, field)
    clause = parser.clauses(field)
    if parser.peek():
        raise PropertyError("KeywordSearch: a bracket too many")
    if not clause:
        return F.lit(False)
    # A function's argument is computed once, however often the function reads it.
    found = F.exists(F.array(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))), clause.score)
    return text.isNotNull() & F.coalesce(clause.needs(F.lower(text)) & found if clause.needs else found, F.lit(False))


@operator("KeywordSearch", "Search")
class KeywordSearch(Operator):
    """Rows whose text matches a keyword query; see keyword_test."""

    attribute: str
    keyword: str

    def run(self, spark, df):
        return df.where(keyword_test(self.keyword, col(df, self.attribute).cast("string"), self.attribute))


# Words that dictionary entries and texts are compared without.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
URL_WORDS = "http https org net com store www html".split()


def stems(text: str) -> frozenset[str]:
    """Stemmed word tokens of a text without stop words; a possessive 's is dropped."""
    words = (re.sub(r"['’]s$", "", w) for w in split_words(text))
    kept = (stem(w) for w in words if w not in STOP_WORDS)
    return frozenset(w for w in kept if w and w not in STOP_WORDS and w not in URL_WORDS)


@operator("DictionaryMatcher", "Search")
class DictionaryMatcher(Operator):
    """Adds whether a text is in a dictionary: a comma-separated list, without case, blanks kept.

    Scan: the text is an entry. Substring: some entry contains the text. Conjunction: all words of some entry are
    among the text's, after stemming; an entry without words matches every text that has one. Null and empty texts
    don't match.
    """

    dictionary: str = wire("Dictionary", "")
    attribute: str = wire("Attribute", "")
    result: str = wire("result attribute", "matched")
    matching: str = wire("Matching type", "Scan")

    def run(self, spark, df):
        name = new_name(df, self.result)
        entries = [e.lower() for e in self.dictionary.split(",")]
        text = F.lower(col(df, self.attribute).cast("string"))
        kind = self.matching.lower()
        if kind.startswith("scan"):
            found = text.isin(entries)
        elif kind.startswith("substring"):
            found = reduce(lambda a, b: a | b, (F.lit(e).contains(text) for e in entries))
        elif kind.startswith("conjunction"):
            wanted = [stems(e) for e in entries]

            @F.pandas_udf("boolean")
            def match(texts: pd.Series) -> pd.Series:
                def one(t):
                    own = stems(t) if t else frozenset()
                    return bool(own) and any(w <= own for w in wanted)

                return texts.map(one).astype(bool)

            found = match(text)
        else:
            raise PropertyError(f"DictionaryMatcher: no matching type {self.matching!r}")
        return df.withColumn(name, F.coalesce(found & (text != ""), F.lit(False)))
