"""URL filtering: rules first, then a naive Bayes score of segmented host and path words.

Host names run words together. A unigram Viterbi search splits them, with word counts of the crawled pages themselves; multinomial
naive Bayes scores the words of host and path. It learns from the pages whose URLs a rule judges, by what the rule doesn't look at, and
from labelled example URLs as a prior.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .brown_lm import frequent_words
from .common import arrow_map, ascii_lower, materialize_table, split_batches, table, utf8, without

#: (host, path, allow or block): a rule fits its host and all subdomains if the URL's path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MAX_RULES = 1000
#: Page words that the unigram model takes at most, by falling count: its vocabulary, which every worker holds.
KNOWN_WORDS = 300_000
#: Splitting: log10 chance of an unknown stretch, and of each of its characters. Deciding: the log odds over which a URL is blocked.
UNKNOWN, UNKNOWN_CHAR = -3.0, -2.0
BLOCK_ODDS = 0.0
#: Of the URLs that rules judge, one in so many is held out; words of fewer of the others than LEAST_URLS say nothing.
HELD_OUT, LEAST_URLS = 5, 3
#: Host names seen lately whose words a worker keeps.
KEPT_HOSTS = 50_000

#: Labelled example URLs: those that were blocked, then those that were allowed.
BLOCKED = """
http://www.casinowinbonus.com/slots/free-spins http://bestcasinoonline.net/casino-bonus/play http://m.luckyslots.example.org/win/jackpot/12
https://royalcasino.club/roulette-win.html http://blog.casinotips.net/poker-casino/win-big http://pokerjackpot.info/free/poker-chips
http://freebetsdaily.com/free-bets/odds https://www.sportsbetodds.net/bets/football http://betwinonline.org/sports-betting/bonus
http://m.freebet.co/bets/today https://topbookmaker.bet/odds/free-bet http://lotterywinner.info/claim/prize-winner
http://winprizenow.com/lottery/claim-prize http://freeprizes.example.net/win/free-iphone http://luckydraw.win/prize/spin
http://cheappillsonline.com/buy-pills/cheap http://www.pharmacydiscount.biz/pills/no-prescription http://buyviagra.example.com/viagra/cheap-pills
https://dietpillsfast.net/diet-pills/buy http://medsforless.org/cheap-meds/pharmacy http://blog.cheapmeds.info/pills/order
http://paydayloanscash.com/fast-loans/apply http://fastcashloan.net/payday-loan/cash-now https://quickloans.example.org/loans/cash
http://cheapreplicawatches.com/replica/watches http://replicabags.shop/cheap-replica/bags http://fakewatches.net/buy/replica-rolex
http://adultvideos.xxx/adult/video/88 http://www.xxxcams.net/cams/live-sex http://sexchatlive.com/sex-chat/adult
http://porntube.example.net/porn/videos http://m.adultx.org/x/nude http://hotgirlsnude.com/girls/nude-pics
https://eroticlive.net/erotic/cams http://escortsnear.me/hot-escorts/city http://adultdating.biz/adult/dating-x
http://spamfarm.example.com/spam/links http://linkfarm.info/buy-links/seo http://seospamtools.net/spam/mailer
http://bulkmailspam.com/farm/spam-list http://cheapbacklinks.biz/seo/link-farm http://articlespinner.net/spam/seo-farm
http://adstrack.example.org/ads/track?id=4 http://clicktracker.net/track/click http://adsserver.biz/ads/banner
http://popupads.com/popup/ads-track http://trackads.info/track/redirect https://bannerads.click/ads/click-track
http://malwaredownload.ru/crack/keygen http://freecracks.net/crack/serial-keys http://warezdownload.org/warez/full-crack
http://torrentmovies.to/torrent/free-movies http://pirategames.net/torrent/crack http://keygenfree.info/keygen/download
http://loginverify.example.com/phishing/account-verify http://secureverifylogin.net/bank/login-verify http://account-update.info/verify/login
http://cryptodoubler.biz/double/bitcoin-profit http://bitcoinprofitfast.com/crypto/profit http://earnfastmoney.net/easy-money/profit
http://getrichquick.info/money/fast-profit http://workhomecash.com/easy-cash/earn http://freecryptogiveaway.org/giveaway/bitcoin
http://hotsinglesnear.com/singles/hot-chat http://miraclediet.net/diet/lose-weight-fast http://weightlosspills.org/pills/diet
http://buyfollowers.biz/cheap-followers/buy http://fakediploma.net/buy-diploma/cheap http://essaycheap.com/buy-essay/fast
http://onlineslots.casino/slots/win-bonus http://blackjackwin.net/blackjack/casino http://bingobonus.co.uk/bingo/free-bonus
http://spinwin.example.org/spin/win-slots http://jackpotcity.bet/jackpot/slots http://horsebets.info/bets/horse-odds
"""
ALLOWED = """
http://www.worldnewstoday.com/news/world http://localnews.example.org/city/news-today https://dailynews.net/news/politics/2024
http://cityweather.org/weather/forecast http://weatherforecast.net/forecast/today https://m.weathermap.info/weather/map
http://universitylibrary.edu/library/research http://www.stateuniversity.edu/research/papers http://openlibrary.example.net/books/history
http://schoolscience.org/science/projects https://scienceforkids.net/school/science http://highschool.example.com/students/calendar
http://historymuseum.org/museum/exhibits http://www.artmuseum.net/art/gallery http://cityarchive.info/archive/photos
http://healthclinic.com/health/advice http://www.familydoctor.org/patients/care http://hospitalcare.example.net/hospital/visits
http://gardenplants.net/garden/tips https://homegarden.info/plants/flowers http://blog.vegetablegarden.com/garden/soil
http://cookingrecipes.com/recipes/soup http://kitchenrecipes.net/cooking/bread http://www.familycooking.org/recipes/dinner
http://travelguide.com/travel/hotels http://traintravel.example.org/train/times http://cityhotels.net/hotel/rooms
https://walkingroutes.info/travel/mountains http://airportguide.net/flights/arrivals http://islandtravel.com/guide/beaches
http://musicband.net/music/concerts http://concerthall.org/tickets/concert http://jazzmusic.example.com/music/albums
http://bookreviews.org/books/review http://authorinterviews.net/author/books http://poetrycorner.info/poems/spring
http://filmreview.com/film/cinema http://citycinema.net/cinema/times http://filmfestival.org/festival/program
http://footballclub.com/football/team http://chessclub.net/chess/results http://www.sportsresults.org/results/league
http://runningclub.info/running/marathon http://tennisschool.example.net/tennis/lessons http://swimmingpool.org/swimming/times
http://softwaredocs.com/docs/manual http://pythoncode.org/python/tutorial http://linuxkernel.net/kernel/docs
https://datascienceblog.com/data/science http://opensourceproject.org/code/project http://www.codelibrary.net/code/docs
http://personalblog.example.com/blog/notes http://photoblog.net/blog/photos http://familyblog.info/blog/about
http://companysite.com/about/contact http://lawfirm.net/law/office http://accountingoffice.org/services/contact
http://furnitureshop.com/shop/tables http://bikerepair.net/bike/repair http://carparts.info/cars/parts
http://citycouncil.org/council/services http://taxoffice.net/tax/forms http://www.publicservices.info/forms/housing
http://charityhelp.org/help/people http://animalrescue.net/animals/adopt http://foodbank.example.org/food/volunteers
http://forumquestions.com/questions/answers http://wikiarticles.org/wiki/article http://dictionarywords.net/words/language
http://productsupport.com/support/help http://printermanual.net/manual/support http://phonesupport.info/help/phone
http://birdwatching.org/birds/forest http://mountainphotos.net/photos/mountains http://riverfishing.com/fishing/rivers
http://languageschool.net/language/courses http://mathlessons.org/math/lessons http://teacherresources.info/school/lessons
http://economicsreview.com/economy/review http://financenews.net/markets/news http://businessdaily.org/business/report
http://www.govservices.org/public/records http://villagehall.net/events/calendar http://theatreplays.com/theatre/program
"""
LABELLED_URLS = tuple((url, y) for y, listed in ((1, BLOCKED), (0, ALLOWED)) for url in listed.split())


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ://, up to / ? # or the end; then up to ? # or the end. Else empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host/path, and its verdict; null where none does. Ties go to the later rule."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into the plan")
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(F.lit(None) if rule is None else rule)
        verdict = F.when(fits, F.lit(v)).otherwise(F.lit(None) if verdict is None else verdict)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def beyond_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """What of host and path the fitting rule doesn't look at; null where none fits."""
    h_length = p_length = F.lit(None).cast("int")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        h_length, p_length = F.when(fits, F.lit(len(h))).otherwise(h_length), F.when(fits, F.lit(len(p))).otherwise(p_length)
    return F.substring(host, F.lit(1), F.length(host) - h_length), F.substring(path, p_length + 1, F.length(path))


_TAG = re.compile(rb"<(?:(script|style)\b)?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[^\W\d_]+|[0-9]+")


def visible(html: bytes) -> bytes:
    """What is outside tags, scripts and styles, in one walk: an unclosed tag, script or style reaches to the end."""
    out, at = [], 0
    while (m := _TAG.search(html, at)) is not None:
        out.append(html[at : m.start()])
        end = html.find(b">", m.end())
        if end >= 0 and m[1]:
            close = re.compile(b"</" + m[1] + rb"\s*>", re.I).search(html, end)
            end = close.end() - 1 if close else -1
        if end < 0:
            return b" ".join(out)
        at = end + 1
    out.append(html[at:])
    return b" ".join(out)


def page_word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word binary, form int, n long): runs of letters of any script in the visible part of all pages, lower-cased."""
    import pyarrow as pa

    def run(batches):
        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in counts], pa.binary()), pa.array([0] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "form", "n"])
            counts.clear()
            return batch

        for batch in split_batches(batches, 0):
            for data in utf8(batch.column(0)):
                counts.update(_WORD.findall(visible(data).decode("utf-8", "replace").lower()))
            if len(counts) >= 200_000:
                yield out()
        if counts:
            yield out()

    found = arrow_map(pages.select(html), run, "word binary, form int, n long")
    return found.groupBy("word").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


def host_and_path(url: str) -> tuple[str, str]:
    """As `url_parts`, for one URL."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    return (m[1], m[2]) if m else ("", "")


class UrlModel:
    """Splits run-together names and scores their words by multinomial naive Bayes.

    `labelled` are (url, 1 for block or 0) pairs; `learned` adds for each word how many other allowed and blocked URLs have it. Only
    the first give the classes' shares: how many URLs a list of rules blocks says nothing of others. Single letters and a host's last
    label, its public suffix, say nothing.
    """

    def __init__(self, counts: dict[str, int], labelled=LABELLED_URLS, learned: dict[str, tuple[int, int]] | None = None) -> None:
        total = sum(counts.values())
        split = [(*host_and_path(url.lower()), y) for url, y in labelled]
        # Words that marks set apart in the paths of labelled URLs count as if the pages had them, too: each time like a
        # hundred-thousandth of all words. Only then can the run-together names of their hosts be split.
        apart = Counter(w for _, path, _ in split for w in _WORD.findall(path))
        weight = {**counts, **{w: counts.get(w, 0) + n * max(1.0, total / 1e5) for w, n in apart.items()}}
        whole = sum(weight.values()) or 1
        self.log = {w: math.log10(n / whole) for w, n in weight.items()}
        self.lengths = sorted({len(w) for w in self.log}, reverse=True)
        by = [Counter(w for host, path, y in split if y == c for w in self.telling(self.words(host), self.suffix(host)) + self.telling(self.words(path), 0)) for c in (0, 1)]
        for w, n in (learned or {}).items():
            for c in (0, 1):
                by[c][w] += n[c]
        known = {w for c in by for w, n in c.items() if n}
        sums = [sum(c.values()) for c in by]
        self.odds = {w: math.log((by[1][w] + 1) / (sums[1] + len(known))) - math.log((by[0][w] + 1) / (sums[0] + len(known))) for w in known}
        urls_of = [sum(y == c for _, _, y in split) for c in (0, 1)]
        self.prior = math.log((urls_of[1] + 1) / (urls_of[0] + 1))

    def suffix(self, host: str) -> int:
        """How many of a host's words its last label is."""
        return len(self.words(host.rpartition(".")[2]))

    @staticmethod
    def telling(words: list[str], suffix: int) -> list[str]:
        """The words that may say something: no single letters, and not the `suffix` last ones."""
        return [w for w in words[: len(words) - suffix] if len(w) > 1]

    def segment(self, name: str) -> list[str]:
        """The likeliest words of a run of letters; ties go to longer last words. A stretch is known or not, however long."""
        n = len(name)
        best, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
        unknown, since = -math.inf, 0  # the best unknown stretch that ends here, and where it starts
        for end in range(1, n + 1):
            if unknown < best[end - 1] + UNKNOWN:
                unknown, since = best[end - 1] + UNKNOWN, end - 1
            unknown += UNKNOWN_CHAR
            best[end], came[end] = unknown, since
            for length in self.lengths:
                if length <= end:
                    p = self.log.get(name[end - length : end])
                    if p is not None and best[end - length] + p > best[end]:
                        best[end], came[end] = best[end - length] + p, end - length
        words, end = [], n
        while end:
            words.append(name[came[end] : end])
            end = came[end]
        return words[::-1]

    def words(self, text: str) -> list[str]:
        """Words of a host or path: runs of letters of any script are split, runs of digits stay, marks only separate."""
        return [w for run in _PIECE.findall(text) for w in ([run] if run[0].isdigit() else self.segment(run))]

    def score(self, words: list[str]) -> float:
        """Log odds of block by `telling` words; those that no labelled URL has say nothing."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


def _judged(pages: DataFrame, rules, url: str, held_out: bool) -> DataFrame:
    """(host, path, y): what rules don't look at in the URLs that they judge, and 1 for block; the fifth that is held out, or the others."""
    host, path = url_parts(F.col(url))
    rule, verdict = fitting_rule(host, path, rules)
    rest_host, rest_path = beyond_rule(host, path, rules)
    mine = F.pmod(F.crc32(F.col(url).cast("binary")), F.lit(HELD_OUT)) == 0
    judged = pages.where(rule.isNotNull() & (mine if held_out else ~mine))
    return judged.select(rest_host.alias("host"), F.lower(rest_path).alias("path"), (verdict == "block").cast("int").alias("y"))


def learn(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> dict[str, tuple[int, int]]:
    """For each word how many allowed and blocked URLs have it, of all URLs that rules judge but those held out.

    Words that any rule looks at are left out wherever they stand. At most KNOWN_WORDS words, by falling count.
    """
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, counts = shared.value, Counter()
        looked = {w for h, p, _ in rules for w in m.words(h) + m.words(p.lower())}
        for batch in batches:
            for h, p, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for w in {*m.telling(m.words(h), 0), *m.telling(m.words(p), 0)} - looked:
                    counts[w, y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "y", "n"])

    each = arrow_map(_judged(pages, rules, url, False), run, "word string, y int, n long")
    count = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    sums = materialize_table(each.groupBy("word").agg(count(0).alias("allowed"), count(1).alias("blocked")))
    top = sums.where(F.col("allowed") + F.col("blocked") >= LEAST_URLS).orderBy(F.desc(F.col("allowed") + F.col("blocked")), "word").limit(KNOWN_WORDS)
    return {r["word"]: (r["allowed"], r["blocked"]) for r in top.collect()}


def held_out_rates(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url") -> DataFrame:
    """(y, urls, right): of the URLs that rules judge and that no model learned from, how many it judges alike without what the rules look at."""
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            odds = [m.score(m.telling(m.words(h), 0) + m.telling(m.words(p), 0)) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([int(o > BLOCK_ODDS) for o in odds], pa.int32())], names=["y", "said"])

    return arrow_map(_judged(pages, rules, url, True), run, "y int, said int").groupBy("y").agg(F.count("*").alias("urls"), F.count_if(F.col("y") == F.col("said")).alias("right"))


def train(pages: DataFrame, html: str = "html", labelled=LABELLED_URLS, rules=RULES, url: str = "url") -> UrlModel:
    """Word counts come from all pages; the vocabulary is the KNOWN_WORDS most frequent. Words of the URLs that `rules` judge are learned.

    `labelled`: (url, 1 for block or 0) pairs, a prior. An empty table leaves them only; without any of both, no URL is blocked but by rules.
    """
    words, n = frequent_words(materialize_table(page_word_counts(pages, html)), KNOWN_WORDS)
    counts = {w.decode(): int(c) for w, c in zip(words, n, strict=True)}
    plain = UrlModel(counts, labelled)
    if url not in pages.columns:
        return plain
    return UrlModel(counts, labelled, learn(pages, plain, rules, url))


def judge(pages: DataFrame, model: UrlModel, rules=RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns `keep` of `pages` and host, path, rule, verdict (allow or block), words and odds, for every row.

    A null url and one without :// have empty host and path, no rule and no words. Rows are independent: repeats and ties need no
    care, empty tables give empty ones, kept columns named like an output are replaced. Long names are split whole.
    """
    import pyarrow as pa

    new = ("host", "path", "rule", "verdict", "words", "odds")
    keep = without(keep, new)
    host, path = url_parts(F.col(url))
    parts = pages.select(*[f"`{c}`" for c in keep], host.alias("host"), path.alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields] + ["words array<string>", "odds double"])
    at = len(keep)

    def run(batches):
        m = shared.value
        hosts: dict[str, tuple[list[str], list[str]]] = {}
        for batch in split_batches(batches, at + 1):
            words, odds = [], []
            for h, p in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                kept = hosts.get(h)
                if kept is None:
                    w = m.words(h)
                    if len(hosts) >= KEPT_HOSTS:
                        hosts.clear()
                    kept = hosts[h] = (w, m.telling(w, m.suffix(h)))
                w = m.words(p.lower())
                words.append(kept[0] + w)
                odds.append(m.score(kept[1] + m.telling(w, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(odds, pa.float64())], names=[*keep, "host", "path", "words", "odds"])

    scored = arrow_map(parts, run, schema)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("odds") > BLOCK_ODDS, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*[f"`{c}`" for c in keep], "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "words", "odds")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of pages; edge cases as in `judge`."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, train(pages)).select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), F.round("odds", 9).alias("odds"))
