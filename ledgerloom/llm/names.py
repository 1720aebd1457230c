"""Reading names of businesses and people as they are typed.

A typed name has a *core* (the words that only this name has), *generic* words shared by many names (trades,
forms of group, given names), legal forms, and remarks such as a branch or a title.  Which words are generic is
learned from the official names: those in at least ``share`` of them.  Typed words that are no generic word
are read as one where they abbreviate or misspell it; several readings may stay open.

Two names of the same core agree if every generic word of the shorter one can stand for one of the longer.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legal forms and small words; they tell nothing apart.
LEGAL = frozenset("PTY LTD LIMITED PROPRIETARY INC INCORPORATED CO COMPANY CORP CORPORATION LLC PLC GMBH NL TRUST TST TRUSTEE PL THE AND OF FOR ATF".split())
TITLES = frozenset("MR MRS MS MISS DR PROF SIR MX".split())
#: English short forms of given names, each with the full names it may stand for.
NICKNAMES = {
    "ALEX": "ALEXANDRA ALEXANDER", "ALEXA": "ALEXANDRA", "ANDY": "ANDREW", "ANN": "ANNE", "ANNA": "ANNE", "ANNIE": "ANNE", "ANTONY": "ANTHONY", "BARB": "BARBARA",
    "BEN": "BENJAMIN", "BESS": "ELIZABETH", "BETH": "ELIZABETH", "BETTY": "ELIZABETH", "BILL": "WILLIAM", "BILLY": "WILLIAM", "BOB": "ROBERT", "BOBBY": "ROBERT",
    "CATE": "KATHERINE", "CATHERINE": "KATHERINE", "CATHY": "KATHERINE", "CHARLIE": "CHARLES", "CHRIS": "CHRISTOPHER CHRISTINE", "DAN": "DANIEL", "DAVE": "DAVID", "DEB": "DEBORAH",
    "DEBBIE": "DEBORAH", "DEBRA": "DEBORAH", "DICK": "RICHARD", "ED": "EDWARD", "EDDIE": "EDWARD", "ELIZA": "ELIZABETH", "FRED": "FREDERICK", "GREG": "GREGORY",
    "GREGOR": "GREGORY", "GREGG": "GREGORY", "HARRY": "HENRY HAROLD", "JACK": "JOHN", "JEANNE": "JEAN", "JEN": "JENNIFER", "JENNY": "JENNIFER", "JIM": "JAMES",
    "JIMMY": "JAMES", "JAMIE": "JAMES", "JO": "JOANNA JOANNE", "JOAN": "JOANNA", "JOANNE": "JOANNA", "JOE": "JOSEPH", "KATE": "KATHERINE", "KATHRYN": "KATHERINE",
    "KATHY": "KATHERINE", "KATIE": "KATHERINE", "KAY": "KATHERINE", "KIT": "CHRISTOPHER KATHERINE", "LEN": "LEONARD", "LEIGH": "LEE", "LEXI": "ALEXANDRA", "LEXIE": "ALEXANDRA", "LIBBY": "ELIZABETH",
    "LIZ": "ELIZABETH", "LIZZIE": "ELIZABETH", "MAGGIE": "MARGARET", "MEG": "MARGARET", "MICK": "MICHAEL", "MIKE": "MICHAEL", "NED": "EDWARD", "NICK": "NICHOLAS",
    "NICOLAS": "NICHOLAS", "NICKY": "NICHOLAS VERONICA", "PAT": "PATRICIA PATRICK", "PATSY": "PATRICIA", "PATTY": "PATRICIA", "PAULIE": "PAUL", "PEGGY": "MARGARET", "PETE": "PETER",
    "RICK": "RICHARD", "ROB": "ROBERT", "ROBBIE": "ROBERT", "RON": "RONALD", "RONNIE": "VERONICA RONALD", "ROSIE": "ROSE", "SAM": "SAMUEL SAMANTHA", "SANDRA": "ALEXANDRA",
    "SANDY": "ALEXANDRA", "STEVE": "STEPHEN STEVEN", "SUE": "SUSAN", "SUSIE": "SUSAN", "SUZANNE": "SUSAN", "SUZY": "SUSAN", "TED": "EDWARD THEODORE", "THEO": "THEODORE",
    "TIM": "TIMOTHY", "TOM": "THOMAS", "TONY": "ANTHONY", "TRICIA": "PATRICIA", "TRISH": "PATRICIA", "VERA": "VERONICA", "WILL": "WILLIAM", "WM": "WILLIAM",
}

_TAIL = re.compile(r"\s(?:T/AS?|TRADING AS|ATF|C/-|-)\s.*$")
_ASIDE = re.compile(r"[\(\[]\s*(?!PTY\b)[^\)\]]*[\)\]]")
_LEGAL_SIGNS = re.compile(r"\bP\s*/\s*L\b|\(\s*PTY\s*\)")
_WORD = re.compile(r"[^\W_]+")


def generic_words(names: DataFrame, name: str, share: float = 0.002, least: int = 5) -> list[str]:
    """The words of at least ``share`` of the distinct official names, and of at least ``least``.

    A name has few words, so at most (words a name) / share of them can qualify: that bounds the list.
    """
    distinct = names.where(F.col(name).isNotNull()).select(F.upper(F.btrim(name)).alias("n")).distinct()
    words = distinct.select(F.explode(F.array_distinct(F.split(F.regexp_replace("n", "'", ""), r"[^\p{L}\p{N}]+"))).alias("w")).where("w <> ''")
    total = distinct.count()
    found = words.groupBy("w").count().where(F.col("count") >= max(least, share * total)).select("w")
    return sorted(r[0] for r in found.collect())


def levenshtein(a: str, b: str, most: int) -> int:
    """The edit distance, or ``most`` + 1 where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row[0] = row[0], j
        low = j
        for i, x in enumerate(a, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
            low = min(low, row[i])
        if low > most:
            return most + 1
    return row[-1]


def _is_subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@dataclass(frozen=True)
class ParsedName:
    core: str
    generics: tuple[str, ...]  # each the readings of one word, joined by |
    words: tuple[str, ...]  # of the core
    plain: str  # all words but legal forms, titles and remarks


class NameReader:
    def __init__(self, generics: list[str]):
        self.generics = [g for g in generics if g not in LEGAL and g not in TITLES and len(g) > 1]
        self._set = frozenset(self.generics)
        self._short: dict[str, set[str]] = {}
        for short, full in NICKNAMES.items():
            for g in full.split():
                self._short.setdefault(g, set()).add(short[0])
        self._read = lru_cache(maxsize=200_000)(self._readings)

    def _readings(self, word: str) -> tuple[str, ...]:
        """The generic words that ``word`` may stand for; empty if it is none."""
        if word in self._set:
            return (word,)
        if word in NICKNAMES:
            full = [g for g in NICKNAMES[word].split() if g in self._set]
            if full:
                return tuple(full)
        if len(word) == 1:  # an initial, perhaps of a short form
            return tuple(g for g in self.generics if g[0] == word or word in self._short.get(g, ()))
        n, found = len(word), []
        for g in self.generics:
            if g[0] != word[0]:
                continue
            m = len(g)
            if n >= 3 and m > n and g.startswith(word):
                found.append((0, g))
            elif n == m >= 5 and sorted(word) == sorted(g) and levenshtein(word, g, 2) == 2:
                found.append((1, g))  # two neighbours swapped
            elif n >= 5 and m >= 6 and (d := levenshtein(word, g, 2 if m >= 7 else 1)) <= (2 if m >= 7 else 1):
                found.append((d, g))
            elif n >= 7 and m >= 7 and word[:6] == g[:6]:
                found.append((2, g))
            elif n <= 7 and 0.2 * m <= n < m and m >= 5 and word[-1] == g[-1] and _is_subsequence(word, g) and (n <= 4 or word[-2:] == g[-2:] or not set(word) & set("AEIOU") or word[:2] == g[:2] or n >= 0.6 * m):
                found.append((1, g))
        if not found:
            return ()
        exact = [g for d, g in found if d == 0]
        if exact:
            return tuple(exact)
        best = min(d for d, _ in found)
        return tuple(g for d, g in found if d == best)

    def parse(self, name: str | None) -> ParsedName | None:
        if name is None:
            return None
        s = unicodedata.normalize("NFKC", name).upper().strip()
        s = _LEGAL_SIGNS.sub(" PTY LTD ", s)
        s = _TAIL.sub(" ", s) if _TAIL.sub(" ", s).strip() else s
        bare = _ASIDE.sub(" ", s)
        s = bare if _WORD.search(bare) else s
        words = _WORD.findall(s.replace("'", "").replace("’", ""))
        words = [w for w in words if w not in LEGAL and w not in TITLES] or words
        core, generic = [], []
        for w in words:
            r = self._read(w)
            if not r and len(w) == 1 and len(words) > 1:
                continue  # an initial of nothing known
            (generic if r else core).append("|".join(r) if r else w)
        if not core:  # all words are common ones: then together they are the name
            core, generic = sorted(words), []
        return ParsedName("".join(core), tuple(sorted(set(generic))), tuple(core), " ".join(words))


def agreement(a: tuple[str, ...], b: tuple[str, ...]) -> int | None:
    """How many generic words match if the names may be the same; None if they cannot.

    Every word of the shorter list needs a word of its own in the longer one.
    """
    if len(a) > len(b):
        a, b = b, a
    rest = [set(x.split("|")) for x in b]
    # the words with the fewest readings choose first
    for x in sorted(a, key=lambda x: x.count("|")):
        own = set(x.split("|"))
        hit = min((i for i, r in enumerate(rest) if own & r), key=lambda i: len(rest[i]), default=None)
        if hit is None:
            return None
        rest.pop(hit)
    return len(a)
