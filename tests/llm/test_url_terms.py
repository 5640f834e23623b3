"""Unwanted addresses are found, and harmless ones that share their letters are left alone."""

import pytest

from tidemill.llm import urls

BLOCKED = [
    "https://onlinecasino.net/",
    "https://www.casinobonus24.net/play",
    "http://best-casino.net",
    "https://x.net/porn/",
    "https://freeporn.net/",
    "https://escort-berlin.net/",
    "https://x.net/a/keygen?id=4",
    "https://x.net/sexy-nude-pics",
    "https://x.net/cheap-pills-online",
    "https://WWW.PHISHING-kit.net/",
    "https://x.net/specialist/cialis",
    "casino without a scheme",
]
ALLOWED = [
    "https://cars.net/ford-escort-1998",
    "https://essex.net/sussex/middlesex",
    "https://specialist.net/socialist",
    "https://scunthorpe.net/",
    "https://adult-education.net/courses",
    "https://news.net/sports/betting-odds-explained",
    "https://x.net/hotel/best-deals",
    "https://x.net/windows/winner",
    "https://x.net/cracker-recipes",
    "https://x.net/casinos",
    "https://x.net/freedom/camera/betty",
    "https://escorted-tours.net/",
    "https://botany.net/malwaring",
    None,
    "",
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = list(enumerate(BLOCKED + ALLOWED))
    return {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}


@pytest.mark.parametrize("i", range(len(BLOCKED)))
def test_blocked(verdicts, i):
    assert verdicts[i].verdict == "block", BLOCKED[i]


@pytest.mark.parametrize("i", range(len(ALLOWED)))
def test_allowed(verdicts, i):
    assert verdicts[len(BLOCKED) + i].verdict == "allow", ALLOWED[i]


def test_a_term_counts_once_by_its_larger_weight():
    assert urls.term_hits("escort.net", "/escort/escort") == (1, 0, 10)
    assert urls.term_hits("x.net", "/escort") == (0, 1, 5)
    assert urls.term_hits(None, None) == (0, 0, 0)


def test_weights_follow_the_rule():
    for terms in (urls.HOST_TERMS, urls.PATH_TERMS):
        assert all(w in (4, 5, 7, urls.REJECT_AT) for w in terms.values())
        assert all(w <= 4 or w == urls.REJECT_AT or t == "sex" for t, w in terms.items() if len(t) < 4)
    assert all(urls.HOST_TERMS[t] == urls.REJECT_AT and urls.PATH_TERMS[t] == 5 for t in urls.STRICT_HOST.split())
