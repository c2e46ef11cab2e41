"""URL filter: host word segmentation and naive Bayes.

Names in hosts and paths are concatenated words.  A unigram model splits them (Viterbi: the
split of highest probability, unknown stretches paying by length), and multinomial naive Bayes
scores the words.  The unigram model is learned: half of its mass is that of the words that all pages and paths
of the corpus hold (the ``max_lexicon`` most frequent ones), half is shared by a small seed lexicon, so that words of
unwanted sites, which pages seldom hold, keep their weight at every corpus size.  The labelled
hosts and words that the Bayes model is fitted on are a parameter: the seed words count as one example each of their kind.  Rules on host and path come first.

Plan: one aggregation counts the words (partial sums first; at most ``max_lexicon`` rows reach the driver);
scoring is a map over url columns alone.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English words common in host names, then words of unwanted sites.
COMMON = (
    "about academy africa air america app archive art asia auto bank base bay beach best big bike bird black blog blue board book books box brain bridge"
    " business cafe camp car care cat center chef church city class clean clinic cloud club coach code coffee college company computer cook craft creative"
    " culture daily data day dental design digital doctor dog dream earth east easy eco edge education energy engine europe event express eye face family"
    " farm fashion field film find fine fire first fish fit flow food forum fresh friend future garden gift global gold good great green group guide hair"
    " hand happy health heart help history holiday home hotel house idea image info insurance international island jobs journal kids kitchen lab lake land"
    " law leader learn legal library life light line list live local mail map market master media medical member men mobile modern moon mountain movie music"
    " nation natural net network new news next night north now ocean office online open orange organic outdoor page paper park partner people pet phone photo"
    " place planet play point post power press pro project public quick radio real red research rest review river road rock room run safe school science sea"
    " search season service shop site sky small smart snow social society software solution south space sport star start station store story street student"
    " studio style summer sun support system talk tea team tech test text theater time today tool top tour town toy track trade train travel tree trust"
    " university valley video view village vision visit voice water way web week west white wild win wind wine wise wood word work world yard year young"
)
UNWANTED = (
    "ad adclick ads adserver adult affiliate baccarat bet bets betting bingo bonus casino casinos cash cheap click clicks coupon crack dating deal deals"
    " discount drug drugs escort escorts fake farm free gamble gambling gratis hack hot jackpot keygen loan loans lottery lotto malware meds nude payday"
    " pharma pharmacy phishing pill pills poker popunder porn prize promo replica roulette scam sex sexy slots spam spyware tracker tracking track viagra"
    " virus warez weightloss win winner xxx x"
)
# Labelled examples, host names of either kind.
BLOCKED_HOSTS = (
    "casino-win casinobonus bestcasinos onlinecasino pokerbonus freebets free-bets betwin bettingbonus slotsjackpot cheap-pills cheappills cheapmeds"
    " pharmapills viagraonline pharmacydiscount adult-x adultxxx adultdating xxxporn pornvideo sexvideo sexydating escortsx nudexxx spam-farm spamfarm"
    " clickfarm adfarm ads-track adstrack adtracker adserver adclick popunderads trackingads affiliateads loanspayday paydayloan lottowin lotterywinner"
    " prizewinner warezcrack crackkeygen fakereplica malwarevirus phishingscam freecash hotbets bingobonus roulettewin freepills cheapviagra winprize"
)
ALLOWED_HOSTS = (
    "dailynews worldnews citylibrary openscience musicschool greengarden familyhealth travelguide localnews techreview bookclub sciencejournal"
    " universitypress cookbook foodblog photoart historytoday sportweek filmreview kidslearn healthcenter greenenergy cloudsoftware opencode datascience"
    " oceanresearch mountainbike springgarden bluesky redriver northlake citypark smallbusiness homedesign artstudio publicradio weatherstation newspaper"
    " moviereview wildbird organicfarm outdoorcamp medicaljournal lawschool bankjournal teamsport winejournal trackfield traintrack winterlight dogtraining"
)
#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
NAME = re.compile(r"[a-z]+")
GENERIC = frozenset("www m com net org example http https html htm php index".split())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Longest rule that fits host or a parent domain and the path's start, as (rule, verdict)."""
    best = F.lit(None).cast("struct<rule string, verdict string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


class Segmenter:
    """Most probable split of a name into lexicon words and unknown stretches."""

    def __init__(self, counts: dict[str, int], seeds: frozenset[str] = frozenset()):
        total = sum(counts.values()) or 1
        mass = 0.5 if seeds else 1.0  # the other half is shared by the seeds alike
        chance = {w: mass * n / total for w, n in counts.items() if n}
        for w in seeds:
            chance[w] = chance.get(w, 0.0) + (1 - mass) / len(seeds)
        self.cost = {w: -math.log(p) for w, p in chance.items()}
        self.longest = max(map(len, chance), default=1)
        # an unknown stretch of n letters: one chance in ten thousand, a tenth for each letter
        self.unknown = lambda n: math.log(10_000) + n * math.log(10)
        self.seen: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if (known := self.seen.get(name)) is not None:
            return known
        best = [(0.0, 0, False)]  # cost, start of the last part, part is a word
        loose = (0.0, 0)  # cheapest place from which an unknown stretch may run, less its letters
        for end in range(1, len(name) + 1):
            cost = loose[0] + self.unknown(0) + end * math.log(10)
            choice = (cost, loose[1], False)
            for start in range(max(0, end - self.longest), end):
                word = self.cost.get(name[start:end])
                if word is not None and best[start][0] + word < choice[0]:
                    choice = (best[start][0] + word, start, True)
            best.append(choice)
            if choice[0] - end * math.log(10) < loose[0]:
                loose = (choice[0] - end * math.log(10), end)
        parts, end = [], len(name)
        while end:
            _, start, word = best[end]
            parts.append(name[start:end] if word else "?" + name[start:end])
            end = start
        if len(self.seen) >= 100_000:
            self.seen.clear()
        self.seen[name] = parts[::-1]
        return parts[::-1]


class Bayes:
    """Multinomial naive Bayes over words; unknown stretches carry no weight."""

    def __init__(self, blocked: list[list[str]], allowed: list[list[str]], prior_blocked: float):
        count = lambda rows: {w: sum(r.count(w) for r in rows) for r in rows for w in r}
        b, a = count(blocked), count(allowed)
        words = {w for w in b.keys() | a.keys() if w[0] != "?"}
        nb, na = (sum(x.get(w, 0) for w in words) + len(words) for x in (b, a))
        self.odds = {w: math.log((b.get(w, 0) + 1) / nb) - math.log((a.get(w, 0) + 1) / na) for w in words}
        self.prior = math.log(prior_blocked / (1 - prior_blocked))

    def score(self, words: list[str]) -> float:
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def names(host: str, path: str) -> list[str]:
    return [w for w in NAME.findall(host + " " + path.lower()) if w not in GENERIC]


def train(counts: dict[str, int], seeds: frozenset[str], blocked: str, allowed: str, prior_blocked: float) -> tuple[Segmenter, Bayes]:
    seg = Segmenter(counts, seeds)
    parts = lambda hosts: [[p for n in NAME.findall(h) for p in seg.split(n)] for h in hosts.split()]
    return seg, Bayes(parts(blocked), parts(allowed), prior_blocked)


def learned_lexicon(slim: DataFrame, pages: DataFrame, html_col: str | None, max_lexicon: int) -> dict[str, int]:
    """Counts of the most frequent words of all paths and, if given, of all pages without their markup."""
    texts = [slim.select(F.lower("path").alias("t"))]  # not hosts: a name would teach itself as one word
    if html_col:
        plain = F.regexp_replace(F.lower(F.col(html_col).cast("string")), r"(?s)<(script|style)\b.*?(?:</\1>|\z)|<[^>]*>", " ")
        texts.append(pages.select(F.translate(plain, "&;", "__").alias("t")))
    found = None
    for t in texts:
        words = t.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?<![\p{L}\p{M}\p{N}_])([a-z]{2,24})(?![\p{L}\p{M}\p{N}_])"), 1)).alias("word"))
        counts = words.groupBy("word").agg(F.count("*").alias("n"))
        found = counts if found is None else found.union(counts)
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(max_lexicon)
    return {r.word: r.n for r in top.collect()}


def _score(counts: dict[str, int], seeds: frozenset[str], blocked: str, allowed: str, prior_blocked: float):
    def run(batches):
        seg, bayes = train(counts, seeds, blocked, allowed, prior_blocked)
        for batch in batches:
            scores, words = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                words.append([p for n in names(host, path) for p in seg.split(n)])
                scores.append(bayes.score(words[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(words, pa.list_(pa.string()))], [*batch.schema.names, "log_odds", "words"])

    return run


def judge_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = None,
    max_lexicon: int = 20_000,
    rules: tuple = RULES,
    lexicon: str = COMMON + " " + UNWANTED,
    blocked: str = BLOCKED_HOSTS + " " + UNWANTED,
    allowed: str = ALLOWED_HOSTS + " " + COMMON,
    prior_blocked: float = 0.2,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds, words) for every row.

    The longest fitting rule decides; where none fits, ``block`` if the words' log odds exceed 0.
    The lexicon is learned from all paths and, where ``html_col`` is given, from all pages.
    Words beginning with ``?`` are unknown stretches.  Null urls and those without ``://`` have an
    empty host and path and are allowed.  Every row is judged by itself; extra columns are ignored.
    """
    url = F.col(url_col).cast("string")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    counts, seeds = learned_lexicon(slim, pages, html_col, max_lexicon), frozenset(lexicon.split())
    scored = slim.mapInArrow(_score(counts, seeds, blocked, allowed, prior_blocked), "page_id long, host string, path string, log_odds double, words array<string>")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.withColumn("fit", rule).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "log_odds", "words")
