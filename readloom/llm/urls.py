"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

A page that a rule fits has the rule's verdict (the longest rule wins). Other pages have their host's
verdict: hosts most of whose pages are blocked by rules seed distrust, hosts most of whose pages are
allowed seed trust; personalised PageRank carries trust along the links between hosts, and distrust goes
against them, in Spark, until the ranks stand still (a number of rounds that the seeds bound). A host takes over the distrust of the hosts that it
links to by their shares of its own links, so one bad link of many weighs little. A host is blocked if its
distrust exceeds its trust by ``MARGIN`` of a seed. Other hosts and pages without a host are allowed.

DataFrame operations only. Scale: links are counted by (host, host) before they are shuffled; a round is one
join and one sum over host edges, both kinds of rank at once. Pages meet the blocked hosts in one join at the
end: those are broadcast while they take ``BROADCAST`` bytes at most, else pages of a host are dealt over
``SALTS`` tasks, so a host with a third of all pages is not one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

DAMPING = 0.85
ROUNDS = 8  # between two tests whether the ranks stand still
TOLERANCE = 1e-6  # of a seed
MARGIN = 0.01  # of a seed: one bad link of 85, or 28 links away from a bad host by hosts with no other links
BROADCAST = 32 << 20
SALTS = 16
_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)"""
_ATTRIBUTE = rf"[\s/]*+%s[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
_ANY, _OTHER = (f"(?:{_ATTRIBUTE % before})*+" for before in ("", r"(?!href[\s=/>])"))
#: One thing that begins with < at a time: a link (its address, with its quotes, is group 1), a comment, an element whose content is text, or any
#: other tag. No quantifier goes back, so a page costs its length.
LINK = (
    rf"""(?is)<a(?:rea)?(?=[\s/]){_OTHER}[\s/]*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+){_ANY}[\s/]*+>"""
    r"|<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]){_ANY}[\s/]*+(?:>.*?(?:</\2(?=[\s/>])|\z)|\z)"
    rf"|<[a-z/]{_ANY}[\s/]*+>?|<[!?][^>]*+>?"
)
# Names of character references that stand for what an address is cut at.
NAMED = {"amp": "&", "AMP": "&", "colon": ":", "sol": "/", "bsol": "\\", "period": ".", "quest": "?", "num": "#", "commat": "@", "equals": "=", "percnt": "%", "lowbar": "_", "Tab": "\t", "NewLine": "\n", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. Rules are a literal list that the caller states."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits is the longest
        out = F.when(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages with host, path, rule and by_rule (the rule's verdict)."""
    located = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return located.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", F.col("_fit.rule")).withColumn("by_rule", F.col("_fit.verdict")).drop("_fit")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _character(code: Column) -> Column:
    """The character of a code point, by its bytes in UTF-8; U+FFFD for 0, surrogates and what is too large."""

    def last(x: Column, shift: int) -> Column:
        return F.shiftright(x, shift).bitwiseAND(63).bitwiseOR(128)

    def packed(x: Column) -> Column:
        two = (F.shiftright(x, 6).bitwiseOR(192)) * 256 + last(x, 0)
        three = (F.shiftright(x, 12).bitwiseOR(224)) * 65536 + last(x, 6) * 256 + last(x, 0)
        four = (F.shiftright(x, 18).bitwiseOR(240)) * 16777216 + last(x, 12) * 65536 + last(x, 6) * 256 + last(x, 0)
        return F.when(x < 128, x).when(x < 2048, two).when(x < 65536, three).otherwise(four)

    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.hex(packed(F.when(bad, F.lit(0xFFFD)).otherwise(code).cast("long")))), "UTF-8")


def dereferenced(text: Column) -> Column:
    """text with its numeric character references, and the named ones of NAMED, decoded."""
    known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def decoded(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^&#[xX]?([0-9a-fA-F]{1,12})", 1)
        code = F.when(part.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        named = F.try_element_at(known, F.regexp_extract(part, "^&([A-Za-z]+);", 1))
        return F.when(part.rlike("^&#[xX]?[0-9a-fA-F]"), _let(code, _character)).otherwise(F.coalesce(named, part))

    parts = F.regexp_extract_all(text, F.lit(r"&#[xX][0-9a-fA-F]++;?|&#[0-9]++;?|&[A-Za-z]++;|[^&]++|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def address(value: Column) -> Column:
    """The address of an attribute's value: without quotes, references decoded, without tabs, line ends and outer spaces, backslashes as slashes."""
    bare = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.regexp_replace(F.translate(dereferenced(bare), "\\\t\n\r", "/"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of links between different hosts. pages: host, html. Links that name no host (with or without a scheme) stay on theirs.

    A link is the first href of an a or area tag. What looks like one inside a comment, a script, another attribute's value or a tag that never ends is none.
    """
    found = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.filter(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: x != "")).alias("value"))
    links = found.select("src", address(F.col("value")).alias("url")).filter(F.col("url").rlike(ABSOLUTE))
    return links.select("src", host_of(F.regexp_replace("url", "^//", "http://")).alias("dst")).filter("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """(kind, host, rank) after so many rounds, or with a tolerance after as many times so many as it takes.

    edges: src, dst, n. seeds: kind ('trust' or 'distrust'), host, seed. Trust follows links, dealt out by the
    sender (the ranks of hosts without further links leave the graph); distrust goes back, as the mean over the
    receiver's links. Either shrinks by the damping in a round, so it ends: trust in sum, distrust at each host.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))  # of the host that links, for either kind
    shares = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    steps = settle(shares.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), "dst", "share").unionByName(shares.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("dst"), "share")))
    ranks = seeds.select("kind", "host", F.col("seed").alias("rank"))
    if not steps.limit(1).count():  # no links: the seeds are all there is
        return ranks.withColumn("rank", F.col("rank") * (1 - damping))
    base = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    # what a round moves is at most the damping's share of what the one before moved, and that began with all seeds
    most = math.inf if tolerance is None else 2 * rounds + math.log(max(2.0, 2 * (seeds.agg(F.sum("seed")).first()[0] or 0)) / (tolerance * (1 - damping))) / -math.log(damping)
    gone = 0
    while True:
        if gone > most:
            raise RuntimeError(f"ranks still move after {gone} rounds")
        gone += rounds
        before = ranks
        for k in range(rounds):
            moved = ranks.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            ranks = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if k % 2 or k == rounds - 1:
                ranks = settle(ranks)
        if tolerance is None:
            return ranks
        apart = ranks.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("by"))
        far = apart.agg(F.sum(F.when(F.col("kind") == "trust", F.col("by"))).alias("trust"), F.max(F.when(F.col("kind") == "distrust", F.col("by"))).alias("distrust")).first()
        if max(far.trust or 0.0, far.distrust or 0.0) <= tolerance * (1 - damping):
            return ranks


def host_verdicts(pages: DataFrame) -> DataFrame:
    """(host, host_verdict) of all hosts of pages (host, html, by_rule) that trust or distrust reaches."""
    shares = (
        pages.filter("host <> ''").groupBy("host")
        .agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "block").alias("blocked"), F.count_if(F.col("by_rule") == "allow").alias("allowed"))
        .withColumn("kind", F.when(F.col("blocked") * 2 > F.col("n"), "distrust").when(F.col("allowed") * 2 > F.col("n"), "trust"))
        .filter("kind is not null")
    )
    seeds = settle(shares.select("kind", "host", F.lit(1.0).alias("seed")))
    ranks = propagate(host_edges(pages), seeds, tolerance=TOLERANCE)
    score = F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(-F.col("rank")))
    return ranks.groupBy("host").agg(F.when(score > MARGIN * (1 - DAMPING), "block").otherwise("allow").alias("host_verdict"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of all pages (page_id, url, html).

    Null urls and urls without :// have empty host and path and are allowed; null html holds no links. Repeated rows
    and null ids are each judged. Other columns, whatever their names, are left out; an empty table gives no rows.
    """
    known = judged(pages.select("page_id", "url", "html"), rules)
    blocked = settle(host_verdicts(known.select("host", "html", "by_rule")).filter("host_verdict = 'block'"))
    rows = known.select("page_id", "host", "path", "rule", "by_rule")
    size = blocked.agg(F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST:
        met = rows.join(F.broadcast(blocked), "host", "left")
    else:
        salts = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "host_verdict", F.lit("allow")).alias("verdict"))
