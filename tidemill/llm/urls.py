"""URL filters: host and path rules, then a weighted vocabulary.

The vocabulary is searched by an Aho-Corasick automaton in one pass over the
URL. A term counts where no letter or digit (a-z, 0-9) touches it. In the host,
names are often written together, so there a strict term that begins no other
word (``JOINED``) also counts where only one of its ends touches others
("onlinecasino", "casinobonus"). One strict term rejects; soft terms reject when the weights of the
distinct ones found reach ``REJECT_AT``.

How weights were set: a word is strict where it has hardly another use than the
unwanted one (``STRICT``), and only in the host where it is also a surname, a car
or a disease (``STRICT_HOST``; in the path it is soft). A word of two uses is soft:
7 where the unwanted use prevails (two such words reject), 5 where the uses are
about equal (two), 4 where the harmless one prevails (three). Words under four
letters are at most 4.

Cases: a null URL, or one without ``://``, has an empty host and path and fits
no rule (what there is of it is searched as a path); a null URL holds no term and is
allowed; repeated rows are judged alike; further columns of the input are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower

REJECT_AT = 10
# The words, by kind of page and by strength.
STRICT = """
    casino sportsbook slotmachine roulette blackjack baccarat bookmaker
    porn porno pornhub xxx hentai milf bdsm camgirl camgirls camsex webcamsex sexcam livesex nsfw escorts callgirl callgirls gangbang blowjob handjob
    malware phishing ransomware keylogger botnet spyware rootkit
    warez torrents crackz serialz nulled keygen keygens
    viagra cialis levitra tramadol xanax oxycontin
    replicawatches counterfeit fakeid payday
"""
STRICT_HOST = "escort gambling poker torrent cracked bingo betting dating loans"
SOFT_7 = "sex sexy nude nudes naked erotic erotik fetish lesbians horny strip stripper hookup hookups jackpot slots freespins deposit leaked crack cracks serial pharmacy steroids"
SOFT_5 = "adult adults amateur teen teens hot bet bets wager lottery lotto bonus cheats cheat hack hacks hacked mod apk spam pills pill drugs weightloss loan debt forex crypto binary replica cheap discount single singles girls"
SOFT_4 = "odds cam cams free win winner wins play online best deals deal offer offers buy sale money cash fast easy download downloads live chat video videos girl click vip"


def _weights() -> tuple[dict[str, int], dict[str, int]]:
    """Weights in the host and in the rest of the URL."""
    both = {}
    for words, weight in ((SOFT_4, 4), (SOFT_5, 5), (SOFT_7, 7), (STRICT, REJECT_AT)):
        both |= {w: weight if weight == REJECT_AT or len(w) > 3 else min(weight, 4) for w in words.split()}
    both["sex"] = 7  # the one short word whose unwanted use prevails
    names = STRICT_HOST.split()
    return both | dict.fromkeys(names, REJECT_AT), both | dict.fromkeys(names, 5)


HOST_TERMS, PATH_TERMS = _weights()
JOINED = frozenset(["porn", *(w for w in STRICT.split() if len(w) >= 6)])
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = frozenset(string.ascii_lowercase + string.digits)
HITS = "strict_hits int, soft_hits int, weight int"


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _found(text: str, weights: Mapping[str, int], joined: bool) -> dict[str, int]:
    """Terms that stand in the text, with their weights."""
    seen = {}
    for end, term in _automaton(tuple(sorted(weights))).iter(text):
        start = end - len(term) + 1
        left = start == 0 or text[start - 1] not in _WORD
        right = end + 1 == len(text) or text[end + 1] not in _WORD
        if (left and right) or (joined and (left or right) and term in JOINED):
            seen[term] = weights[term]
    return seen


def term_hits(host: str | None, rest: str | None, host_terms: Mapping[str, int] = HOST_TERMS, path_terms: Mapping[str, int] = PATH_TERMS) -> tuple[int, int, int]:
    """Strict and soft terms in the URL, each counted once by its larger weight, and their weight."""
    seen = _found((rest or "").translate(_LOWER), path_terms, False)
    for term, weight in _found((host or "").translate(_LOWER), host_terms, True).items():
        seen[term] = max(weight, seen.get(term, 0))
    strict = sum(w >= REJECT_AT for w in seen.values())
    return strict, len(seen) - strict, sum(seen.values())


def vocabulary_hits(host: Column, rest: Column, host_terms: Mapping[str, int] = HOST_TERMS, path_terms: Mapping[str, int] = PATH_TERMS) -> Column:
    def hits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, rests in batches:
            found = [term_hits(h, r, host_terms, path_terms) for h, r in zip(hosts, rests, strict=True)]
            yield pd.DataFrame(found, columns=["strict_hits", "soft_hits", "weight"])

    hits.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(hits, HITS)(host, rest)


def behind_host(url: Column) -> Column:
    """Everything after the host; the whole of a URL without ``://``."""
    rest = _rest(url)
    return F.when(F.locate("://", url) > 0, F.substr(rest, F.length(F.regexp_extract(rest, "^([^/?#]*)", 1)) + 1)).otherwise(url)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: str) -> Column:
    """``rule`` or ``verdict`` of the longest rule that fits, else null."""
    out = None
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        value = F.lit(domain + start if field == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    host_terms: Mapping[str, int] = HOST_TERMS,
    path_terms: Mapping[str, int] = PATH_TERMS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the terms found, for every page."""
    host, path = F.col("host"), F.col("path")
    url = F.col("url")
    hits = vocabulary_hits(host_of(url), behind_host(url), host_terms, path_terms)
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), hits.alias("_h"))
    own = F.when(F.col("_h.weight") >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id",
        "host",
        "path",
        longest_rule(host, path, rules, "rule").alias("rule"),
        F.coalesce(longest_rule(host, path, rules, "verdict"), own).alias("verdict"),
        "_h.strict_hits",
        "_h.soft_hits",
        "_h.weight",
    )
