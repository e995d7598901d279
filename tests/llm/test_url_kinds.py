"""Operator 9 on hosts and paths that its labelled table does not hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.llm import urls

UNWANTED = ("casino-win", "cheap-pills", "free-bets", "ads-track", "adult-x", "spam-farm")


def model_of(spark, rows):
    return urls.fit(spark.createDataFrame(rows, "url string, blocked int"))


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.seed_labels(spark))


def blocked(spark, model, pages):
    """The URLs that the model alone blocks."""
    d = spark.createDataFrame([(u, u) for u in pages], "page_id string, url string")
    return {r.page_id for r in urls.judge(d, model, rules=()).where("verdict = 'block'").collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_hosts_of_the_pages(spark, model, sf):
    assert not set(UNWANTED) & set(urls.BLOCKED_HOSTS)
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url")
    wrong = urls.judge(pages, model, rules=()).where((F.col("verdict") == "block") != F.col("host").rlike("|".join(UNWANTED)))
    assert wrong.select("host", "path", "p_block").collect() == []


def test_kinds_held_out(spark):
    # a kind without any label is not known by its n-grams (README); it must not disturb the others
    rest = [h for kind, hosts in urls.BLOCKED_KINDS.items() if kind not in ("essays", "replicas") for h in hosts]
    model = model_of(spark, urls.seed_rows(rest))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    assert urls.judge(pages, model, rules=()).where((F.col("verdict") == "block") != F.col("host").rlike("|".join(UNWANTED))).count() == 0


def test_hosts_held_out(spark):
    caught = false = 0
    for k in range(3):
        bad, good = urls.BLOCKED_HOSTS[k::3], urls.ALLOWED_HOSTS[k::3]
        model = model_of(spark, urls.seed_rows([h for h in urls.BLOCKED_HOSTS if h not in bad], [h for h in urls.ALLOWED_HOSTS if h not in good]))
        caught += len(blocked(spark, model, [f"https://www.{h}.com/en/5" for h in bad]))
        false += len(blocked(spark, model, [f"https://www.{h}.com/en/5" for h in good]))
    assert caught >= 0.35 * len(urls.BLOCKED_HOSTS)
    assert false <= 0.05 * len(urls.ALLOWED_HOSTS)


def test_paths_alone(spark, model):
    bad = ["https://www.therha.example.com/casino/free-spins/cheap-pills", "https://garden.example.com/buy/cheap-viagra", "https://www.museum.org/warez/keygen",
           "https://therha.example.com/fr/online-poker-bonus", "https://ththin.example.net/adult/porn-video"]
    good = ["https://www.therha.example.com/en/5", "https://garden.example.com/buying-plants/", "https://www.museum.org/en/1", "https://ththin.example.net/adults/opening-hours"]
    assert blocked(spark, model, bad + good) == set(bad)


def test_bare_buy(spark, model):
    assert not blocked(spark, model, ["https://garden.example.com/buy/"])


# Names of every sort that the table does not hold.
ORDINARY = (
    "en.wikipedia.org/wiki/Main_Page bbc.co.uk www.amazon.com/buy/books arxiv.org/abs/1 trackandfield.org essex.police.uk crackle.com imdb.com/title/tt1 pills-and-pillars.edu zzqqxv.io "
    "github.example.com arxiv.example.com www.paypal.com/login mit.edu nasa.gov elpais.es wordpress.org flickr.com dropbox.com netflix.com linkedin.com etsy.com ebay.co.uk ikea.com "
    "lufthansa.de renfe.es sncf.fr loc.gov archive.org gutenberg.org khanacademy.org coursera.org duolingo.com spotify.com bandcamp.com vimeo.com twitch.tv medium.com quora.com yelp.com "
    "tripadvisor.com booking.com airbnb.com zillow.com craigslist.org cnn.com aljazeera.com faz.net corriere.it asahi.jp slashdot.org sourceforge.net gnu.org postgresql.org rust-lang.org "
    "golang.org kotlinlang.org nodejs.org who.int un.org europa.eu cern.ch zzqqxv.io/ x.y").split()


def test_ordinary_hosts_are_allowed(spark, model):
    wrong = blocked(spark, model, ["https://" + u for u in ORDINARY])
    assert wrong == set()
    # what the table does not know at all is allowed, far from the cut
    unknown = urls.judge(spark.createDataFrame([(0, "https://qzxjv.wq/"), (1, "qq://q")], "page_id long, url string"), model, rules=()).collect()
    assert all(r.p_block < 0.3 for r in unknown)


def test_paths_held_out(spark, monkeypatch):
    paths, caught = urls.BLOCKED_PATHS, 0
    for k in range(3):
        bad = paths[k::3]
        monkeypatch.setattr(urls, "BLOCKED_PATHS", tuple(p for p in paths if p not in bad))
        caught += len(blocked(spark, model_of(spark, urls.seed_rows()), [f"https://www.therha.example.com{p}" for p in bad]))
    assert caught >= 0.5 * len(paths)
