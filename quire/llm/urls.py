"""Operator 9: URL filters by logistic regression on hashed n-grams.

A URL's host and path are cut into character n-grams (``GRAMS`` lengths; the
host between ``^`` and ``$``), hashed into ``BUCKETS`` features, each present
or absent.  A logistic regression over them is trained from a small labelled
URL table; a URL is blocked if its probability reaches ``CUT``.  Rules of
(verdict, host, path) go first: a rule fits its host and all subdomains if
the path starts with the rule's, and the longest fitting rule decides.

Native: features, scores and rules are column expressions; nothing is
shuffled.  The labelled table is the only thing the driver reads, at most
``FIT_ROWS`` rows of it in the order of their hashes.

Defined results: a null URL or one without ``://`` has an empty host and
path, fits no rule and is allowed; a URL that is too short for an n-gram is
judged by the intercept, which allows it; labels that are null or neither 0 nor 1 are left
out; with labels of one kind or none the method allows all; repeated rows
are judged alike; further columns pass by.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read

GRAMS = (3, 4, 5)
BUCKETS = 1 << 14
CUT = 0.5
FIT_ROWS = 12_000
STEPS = 300
RATE = 0.5
MOMENTUM = 0.9
RIDGE = 0.0001

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# The small labelled table: unwanted kinds of site, each with the hosts such
# sites use, against ordinary ones.  None is a host of the given pages.
BLOCKED_KINDS = {
    "casino": ("casino", "casino-bonus", "online-casino", "win-casino", "poker-win", "slots-win", "jackpot-slots", "royal-casino", "win-big-jackpot"),
    "pharmacy": ("cheap-meds", "pills-online", "buy-pills", "cheap-viagra", "pharmacy-pills", "diet-pills", "cheapest-pills-shop"),
    "betting": ("free-bet", "bets-online", "sports-bets", "betting-tips", "free-spins", "bet-now", "best-bets"),
    "adverts": ("ads", "adserver", "track-ads", "click-track", "tracker", "ads-click", "banner-ads", "adtrack", "pixel-track", "popunder-ads"),
    "adult": ("free-porn", "porn-tube", "xxx-video", "adult-video", "adult-dating", "x-adult", "adult-cams", "sex-chat", "hot-sex-cams", "xxx"),
    "loans": ("payday-loans", "cheap-loans", "instant-loans", "fast-cash-loan", "quick-cash"),
    "replicas": ("replica-watches", "fake-rolex", "cheap-replica-bags", "fake-id-shop"),
    "ringtones": ("free-ringtones", "ringtones-download", "free-screensavers"),
    "farms": ("link-farm", "spam-links", "spam", "content-farm", "farm-links", "spam-blog", "backlink-farm", "buy-backlinks", "spamfarm", "click-farm", "seo-spam", "article-spinner"),
    "crypto": ("crypto-pump", "crypto-doubler", "bitcoin-doubler", "pump-signals", "crypto-giveaway", "free-bitcoin", "forex-signals", "token-presale"),
    "followers": ("buy-followers", "buy-likes", "cheap-followers", "free-followers", "buy-reviews", "instant-likes"),
    "warez": ("warez", "free-warez", "cracked-software", "keygen-crack", "serial-keys", "torrent-crack", "nulled-scripts", "crack-download"),
    "phishing": ("account-verify-login", "secure-login-update", "verify-account", "paypa1-login", "prize-claim", "you-won-prize", "claim-your-prize"),
    "get-rich": ("get-rich-quick", "make-money-fast", "earn-cash-online", "work-from-home-cash", "money-fast"),
    "essays": ("essay-mill", "buy-essays", "cheap-essay-writer", "buy-diploma"),
}
BLOCKED_HOSTS = tuple(h for hosts in BLOCKED_KINDS.values() for h in hosts)
ALLOWED_HOSTS = (
    "news", "the-times", "daily-herald", "garden-notes", "weather", "university", "library", "museum", "science-review",
    "cooking", "history-forum", "travel-guide", "art-and-culture", "city-council", "health-service", "open-source",
    "wiki", "mathematics", "physics-today", "rivers-and-lakes", "the-other-side", "thinking-aloud", "another-reader",
    "northern-lights", "theatre", "southern-star", "the-one-thing", "her-station", "nation-and-region", "tradition",
    "winter-sports", "windows-help", "cheese-makers", "address-book", "loans-of-books", "freedom-press", "broadcast",
    "better-homes", "alphabet", "railway-tracks", "casino-architecture-history", "pillars-of-rome",
    "within", "therein", "the-inn", "robin", "latin-lessons", "dolphin", "thin-ice", "adulthood-studies", "rethinking", "thinking",
    "farmers-market", "hill-farm", "organic-farming", "dairy-farm-shop", "family-farms", "cryptography-lectures", "cryptic-crosswords",
    "water-pumps", "pumpkin-recipes", "followers-of-rome", "crackers-and-cheese", "music-links", "golf-links", "seoul-guide",
    "essays-on-poetry", "national-bank", "account-of-a-journey", "prize-winning-novels", "nobel-prize", "software-engineering",
    "free-range-eggs", "free-software", "cheap-eats", "cash-and-carry", "quick-bread", "instant-history", "moneta", "spanish-lessons", "spa-gardens",
    "data-tracks", "music-tracks", "clicking-beetles", "sussex-walks", "essex-county", "buyers-guide", "reviews-of-books", "torrents-and-rivers", "keys-and-locks",
    "the-thinker", "northland", "shorelines", "then-and-now", "anthology", "other-worlds", "ethnography", "there-and-back", "thatched-roofs", "whether-or-not",
    "stationery", "information", "education", "notation", "edinburgh", "reading-room", "meridian", "andes", "iron-works", "ocean-lore", "easter", "restaurant",
    "ledger", "sherwood", "washing-lines", "whistle", "shepherd", "the-ring", "sounds", "outdoors", "forestry", "orchard", "lyrics", "family-tree", "tables", "cable-cars",
    "nthdegree", "months", "healthy-teeth", "mother-tongue", "weathering", "gathering", "father", "earth-science", "ethics", "method", "pathways", "thrush", "threads", "thunder",
    "that-place", "whatnot", "hat-makers", "chatham", "chateau-walks", "this-and-that", "wharf", "heat-pumps", "hathaway", "anthill", "chapters", "sextant",
)
# More ordinary names, of every sort: without them the table knows few beginnings and ends of words.
PLAIN_HOSTS = tuple((
    "github wikipedia stackoverflow amazon adobe paypal reddit bestbuy youtube microsoft apple mozilla debian ubuntu python kernel apache oracle "
    "nytimes guardian reuters telegraph economist lemonde spiegel elpais figaro zeitung nature science lancet springer elsevier jstor "
    "harvard stanford oxford cambridge sorbonne heidelberg salamanca berkeley princeton toronto police hospital parliament senate embassy "
    "trackandfield crackling football cricket tennis rugby hockey marathon cycling swimming olympics basketball chess bridge-club "
    "bakery butcher grocer florist plumber carpenter electrician dentist optician tailor barber hotel hostel camping ferry airport station "
    "bank insurance mortgage savings pension accountant lawyer notary auction estate-agent furniture kitchen bathroom carpets curtains paint "
    "bicycle motor garage tyres petrol electric solar boiler chimney roofing window door fence timber brick concrete steel copper "
    "apple-orchard vineyard brewery cider coffee chocolate cheese butter honey bread pasta salad soup spice pepper salt sugar vinegar "
    "horse cattle sheep poultry kennel cattery aquarium zoo wildlife birdwatch butterfly insects mushroom moss fern oak beech willow "
    "piano guitar violin trumpet opera ballet cinema gallery sculpture painting drawing pottery weaving knitting sewing quilting "
    "novel poem story fable comics magazine journal gazette chronicle observer mirror express record bulletin courier dispatch "
    "algebra geometry calculus biology chemistry botany geology astronomy climate oceans glacier volcano desert island mountain valley "
    "school college kindergarten teacher student homework dictionary grammar spelling exam degree diploma-office graduate alumni "
    "clinic nurse surgeon vaccine allergy asthma diabetes nutrition fitness yoga massage sleep vision hearing pillow blanket "
    "router server database compiler browser keyboard printer camera telescope microscope battery cable modem satellite radio").split())
# Numbered pages, as most sites have them.
NUMBERED_PATHS = tuple(f"/{lang}/{n * 7919 % 9973}{end}" for n, (lang, end) in enumerate(
    ((a, b) for _ in range(10) for a in ("en", "fr", "de", "es") for b in ("", "/", ".html", "/index.html", "-2")), 1))
# Paths, dealt to hosts of both kinds: an unwanted path marks a page of any host.
ALLOWED_PATHS = (
    "/en/2718", "/fr/314/", "/de/1618.html", "/es/5772", "/", "", "/index.html", "/about", "/about/team", "/contact", "/news/2021/05/12/city-council-meets",
    "/articles/the-history-of-the-railway", "/wiki/Mathematics", "/recipes/pumpkin-soup", "/health/pharmacy-opening-hours", "/blog/2019/thinking-aloud",
    "/sports/results", "/books/free-verse", "/en/17/", "/fr/8423", "/de/42.html", "/es/9/", "/en/5", "/travel/rome/pillars", "/science/physics/thin-films",
    "/docs/getting-started", "/library/catalogue/therein", "/shop/winter-coats", "/farm/visit", "/music/tracks/12", "/reviews/another-novel", "/2020/11/the-other-side",
    "/products/water-pumps", "/forum/thread/99", "/events/theatre", "/account/settings", "/login", "/search/results", "/free-range-eggs", "/cheap-eats-in-town", "/weather/today",
    "/buy/tickets", "/buy/gift-cards", "/buy/used-bikes", "/buy", "/buy/house", "/where-to-buy", "/adults/classes", "/adult-education", "/adults-and-children", "/download/manual.pdf", "/track-your-order", "/verify-email", "/track/record",
    "/links", "/loans/books", "/followers", "/essays/on-poetry", "/click-here", "/videos/lectures", "/buying-guide", "/opening-hours", "/software/releases", "/account/orders", "/cash-desk",
    *NUMBERED_PATHS,
)
BLOCKED_PATHS = (
    "/casino/free-spins", "/casino/bonus", "/online-casino/win", "/slots/jackpot", "/poker/win-cash", "/cheap-pills", "/buy/viagra", "/shop/cheap-viagra-pills", "/meds/no-prescription",
    "/pharmacy/diet-pills", "/free-bets", "/bets/sports-bets", "/betting/tips", "/ads/click", "/ads/track.gif", "/track/pixel", "/banner-ads/popunder", "/adserver/click",
    "/xxx/free-porn", "/porn/video", "/adult/dating", "/adult-cams/", "/sex-chat", "/payday-loans", "/loans/instant-cash", "/replica-watches", "/fake-rolex", "/free-ringtones",
    "/spam/links", "/link-farm/page1", "/backlinks/buy", "/buy-backlinks", "/crypto-pump", "/bitcoin-doubler", "/crypto/giveaway", "/buy-followers", "/followers/cheap",
    "/warez/download", "/crack/keygen", "/software/crack-serial", "/verify-account/login-update", "/claim-your-prize", "/you-won/prize", "/make-money-fast", "/get-rich-quick",
    "/poker-online", "/online-poker/bonus-cash", "/roulette/online-bonus", "/bonus/poker", "/en/casino-poker-bonus", "/porn-video", "/adult/porn", "/buy/pills", "/betting-bonus",
    "/buy-essays", "/essay/buy-cheap", "/wp-content/cheap-viagra", "/blog/online-casino-bonus", "/forum/buy-pills-online",
)
_SITES = ("{}.example.com", "www.{}.example.com", "m.{}.example.net", "blog.{}.example.org", "www.{}.com", "{}.org", "{}.net", "en.{}.io", "{}.co.uk", "{}.edu")
# Of the URLs judged so many are unwanted, far fewer than of the table's rows.
PRIOR = 0.2
# Rows of each host: with ordinary paths by kind of host, with unwanted paths.
ORDINARY_PER_HOST = {0: 12, 1: 8}
BAD_PER_HOST = 4


def seed_rows(blocked_hosts=BLOCKED_HOSTS, allowed_hosts=(*ALLOWED_HOSTS, *PLAIN_HOSTS)) -> list[tuple[str, int]]:
    """(url, blocked) of the small table: every host at the usual sites with
    ordinary paths in turn, and with unwanted ones."""
    rows = []
    for y, hosts in ((1, blocked_hosts), (0, allowed_hosts)):
        for i, h in enumerate(hosts):
            for paths, n, blocked in ((ALLOWED_PATHS, ORDINARY_PER_HOST[y], y), (BLOCKED_PATHS, BAD_PER_HOST, 1)):
                rows += [("https://" + _SITES[k % len(_SITES)].format(h) + paths[(n * i + k) % len(paths)], blocked) for k in range(n)]
    return rows


def seed_labels(spark: SparkSession) -> DataFrame:
    """The small table as (url, blocked)."""
    return spark.createDataFrame(seed_rows(), "url string, blocked int")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring_index(F.regexp_replace(u, r"(?s)^.*?://", ""), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substr(rest, F.length(host) + 1)


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path."""
    parts = [F.concat(F.lit("^"), host, F.lit("$")), F.lower(path)]

    def bucket(part: int):
        return lambda g: F.pmod(F.xxhash64(F.lit(part), g), F.lit(BUCKETS)).cast("int")

    def grams(text: Column, n: int) -> Column:
        # one pass, whatever the length
        return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))

    return F.array_distinct(F.concat(*[F.transform(grams(t, n), bucket(k)) for k, t in enumerate(parts) for n in GRAMS]))


class Model:
    """Weights by bucket and the intercept."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def probability(self, found: Column) -> Column:
        if not self.weights:
            return F.lit(0.0)
        # one literal: the plan folds it before it runs
        dense = F.split(F.lit(",".join(repr(self.weights.get(k, 0.0)) for k in range(BUCKETS))), ",").cast("array<double>")
        z = F.aggregate(found, F.lit(float(self.bias)), lambda acc, k: acc + F.get(dense, k))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(labels: DataFrame) -> Model:
    """Full-batch gradient descent over the bounded labelled table (url, blocked)."""
    host, path = split_url(F.col("url"))
    rows = (labels.where(F.col("blocked").isin(0, 1)).select(F.col("url"), F.col("blocked").cast("int").alias("blocked"))
                  .orderBy(F.xxhash64("url"), "url", "blocked").limit(FIT_ROWS)
                  .select(features(host, path).alias("k"), "blocked").collect())
    if len({r["blocked"] for r in rows}) < 2:
        return Model({}, 0.0)
    data = [(r["k"], float(r["blocked"])) for r in rows]
    # n-grams of one row tell nothing of the next
    row, col = np.repeat(np.arange(len(rows)), [len(r["k"]) for r in rows]), np.array([b for r in rows for b in r["k"]], np.int64)
    often = np.bincount(col, minlength=BUCKETS) > 1
    row, col = row[often[col]], col[often[col]]
    y, w, bias = np.array([float(r["blocked"]) for r in rows]), np.zeros(BUCKETS), 0.0
    dw, db = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        z = bias + np.bincount(row, w[col], len(rows))
        d = y - 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        dw = MOMENTUM * dw + np.bincount(col, d[row], BUCKETS) / len(rows) - RIDGE * w
        db = MOMENTUM * db + d.mean()
        w += RATE * dw
        bias += RATE * db
    # the table holds far more unwanted rows than the web: what no n-gram speaks for is allowed
    bias += np.log(PRIOR / (1 - PRIOR)) - np.log(y.mean() / (1 - y.mean()))
    return Model({int(b): float(w[b]) for b in np.flatnonzero(often)}, float(bias))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, says = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(says)
    return name, says


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row."""
    host, path = split_url(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    d = d.select("*", rule.alias("rule"), says.alias("says"), model.probability(features(F.col("host"), F.col("path"))).alias("p"))
    p = F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(F.col("p"))
    return d.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(p >= CUT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    p.alias("p_block"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), fit(seed_labels(spark)))
