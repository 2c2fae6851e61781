"""URL filters: rules first, then trust and distrust that travel over host links.

A rule (host, path) fits its host and all subdomains if the url's path starts with the
rule's; the longest rule wins. Pages that a rule judges seed two walks over the host
graph: personalised PageRank from hosts by their allowed pages, following links (who is
linked from trusted hosts is trusted), and the same from hosts by their blocked pages
against the links (who links to blocked hosts is distrusted). A host whose distrust
exceeds its trust is blocked, and so are its pages that no rule judges.

Edges: links of the html, relative ones leading to their own host, and steps between a
host and its direct parent domain, up to the registrable one, whether or not the domains
between have pages (a link of a page of m.a.org speaks for a.org, too). Registrable is what
has one label more than a public suffix: the last label, or one of `suffixes` (two labels
each, a parameter); so hosts of different owners share no parent. Addresses have no parents.
In the graph a host has no port and no user name. All of it is DataFrame work; the walk
carries one row a host and goes on until the ranks stand still.

Nulls and edge cases: a null url, or one without ://, has an empty host and path; no rule
fits it, it takes no part in the graph, and its verdict is the default; a null html has no
links; rows with equal page_id, and repeated rows, are judged each and each of their links
counts; very long urls and htmls are searched whole, in time that grows with their length
(a page is cut at each >, and a tag that isn't closed, or has no href, is read once); a host
of more than 253 characters, which no name server knows, steps to the longest domain above it
that has fewer; of rules of equal
length the first in code point order wins; a host whose distrust equals its trust, or that
no walk reaches, gets the default, allow; an empty table gives an empty result; the result
has the named columns only, whatever others the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, load, offered, salted, small, stash

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: A walk ends when a round changes the ranks by no more than this share of the seeds' mass, all hosts together.
TOLERANCE = 1e-4
#: Names under which anyone may register, besides the last labels.
SUFFIXES = tuple(f"{second}.{last}" for last, seconds in {
    "uk": "co org me ltd plc net ac gov sch nhs", "au": "com net org edu gov id", "nz": "co net org ac govt", "jp": "co ne or ac go", "kr": "co or ne ac go", "in": "co net org ac gov",
    "br": "com net org gov edu", "za": "co org net ac gov", "mx": "com org net gob edu", "ar": "com org net gob edu", "tr": "com org net gov edu", "cn": "com net org gov edu ac", "tw": "com org net gov edu",
    "hk": "com org net gov edu", "sg": "com org net gov edu", "my": "com org net gov edu", "id": "co or go ac web", "th": "co or go ac in", "il": "co org net ac gov", "pk": "com org net gov edu", "ua": "com org net gov edu", "pl": "com org net gov edu", "com": "uk us de eu br cn jpn gb",
}.items() for second in seconds.split())
#: The longest name of a host.
LONGEST = 253
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    best = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best if best is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(host: Column) -> Column:
    """The host in the graph: without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", "")


def links_of(html: Column) -> Column:
    """array<string>: where the anchors of a page lead, in linear time.

    No tag goes beyond a >, so the page is cut there. What comes after the last href of a piece
    is left out, so that each anchor found has one and is read once.
    """
    url = r"href\s*=\s*[\"']?([^\"'\s>]+)"
    pieces = F.filter(F.split(F.coalesce(html, F.lit("")), ">"), lambda x: x.rlike(r"(?i)<a\s"))
    upto = F.transform(pieces, lambda x: F.regexp_extract(x, rf"(?is)^.*{url}", 0))
    return F.flatten(F.transform(upto, lambda x: F.regexp_extract_all(x, F.lit(rf"(?is)<a\s.*?{url}"), F.lit(1))))


def domains(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """array<string>: a host and the domains above it, the longest first, down to the registrable one; of a host of more than LONGEST characters the domains alone."""
    tail = F.right(host, F.lit(LONGEST))
    known = F.when(F.length(host) <= LONGEST, host).when(F.instr(tail, ".") > 0, F.substring(tail, F.instr(tail, ".") + 1, F.lit(LONGEST))).otherwise("")
    parts = F.split(known, r"\.")
    least = F.when(F.substring_index(known, ".", -2).isin(*suffixes), 3).otherwise(2)
    n = F.size(parts) - least + 1
    none = F.array().cast("array<string>")
    address = host.rlike(r"^[0-9.]+$|^\[")
    return F.when((n < 1) | address, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def host_edges(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, dst, w) from (_host, html), one row a pair, w the number of links."""
    links = links_of(F.col("html"))
    # links within the host are counted, not spread out: most links are relative
    read = pages.where("_host <> ''").select(F.col("_host").alias("src"), links.alias("links"))
    far = F.filter("links", lambda u: u.rlike(r"^(?i)(https?:)?//"))
    hosts = F.transform(far, lambda u: node_of(F.translate(F.regexp_extract(u, r"//([^/?#]*)", 1), UPPER, LOWER)))
    rows = read.select("src", (F.size("links") - F.size(far)).alias("own"), hosts.alias("hosts"))
    own = rows.groupBy("src").agg(F.sum("own").cast("double").alias("w")).select("src", F.col("src").alias("dst"), F.greatest("w", F.lit(1.0)).alias("w"))
    out = rows.select("src", F.explode("hosts").alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    both = stash(own.union(out).groupBy("src", "dst").agg(F.sum("w").alias("w")), "host_links")
    # a host and the domains above it each step to the next
    named = both.select(F.col("dst").alias("host")).union(both.select("src")).distinct()
    path = named.select(F.array_distinct(F.concat(F.array("host"), domains(F.col("host"), suffixes))).alias("path")).where(F.size("path") > 1)
    up = path.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("host"), F.element_at("path", i + 1).alias("up")))).alias("s")).select("s.*").distinct()
    steps = up.select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1.0).alias("w")).union(up.select("up", "host", F.lit(1.0)))
    return both.union(steps).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def walk(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (host, rank) over edges(src, dst, w) from seeds(host, mass).

    It goes on until a round changes the ranks, summed over the hosts, by no more than
    tolerance times the seeds' mass, or for the given rounds. A round changes them by at most
    2 * damping^round of that mass, so it ends, at 1e-4 after 64 rounds at the latest.
    Ranks are in units of the seeds' mass, so those of two walks can be compared.
    One row a host goes round; links are summed by host with partial sums, and those that
    leave a hub are joined in parts, so that a hub is no hot spot. Mass of hosts without a way out is lost; every host with
    pages has one, its own links.
    """
    start = stash(seeds.where("mass > 0").groupBy("host").agg(F.sum("mass").alias("s")), "walk_start")
    mass = start.agg(F.sum("s")).first()[0]
    out = edges.groupBy("src").agg(F.sum("w").alias("o"))
    links, hubs = salted(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("o")).alias("p")), "src", "dst", "walk_links")
    rank = start.select("host", F.col("s").alias("rank"))
    i, held = 0, None
    while mass and (rounds is None or i < rounds):
        i += 1
        check = rounds is None and i % 4 == 0
        moved = offered(rank.withColumnRenamed("host", "src"), "src", hubs).join(links, ["src", "_s"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        new = moved.join(start, "host", "full").select("host", (F.lit(damping) * F.coalesce("m", F.lit(0.0)) + F.lit(1 - damping) * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if check:
            was = rank.select("host", F.col("rank").alias("was"))
            new = new.join(was, "host", "full").select("host", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("was", F.lit(0.0)).alias("was"))
        if i % 2 == 0 or i == rounds:
            new = stash(new, "walk")
            if held is not None:
                discard(held)
            held = new
        rank = new.select("host", "rank")
        if check and (new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) <= tolerance * mass:
            break
    return rank


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.0, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)."""
    named = pages.select("page_id", host_of(F.col("url")).alias("_host"), path_of(F.col("url")).alias("_path"), "html")
    rows = named.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules)).withColumn("_node", node_of(F.col("_host")))
    counts = rows.where("_node <> ''").groupBy(F.col("_node").alias("_host")).agg(F.count_if(F.col("_rule.verdict") == "allow").cast("double").alias("good"), F.count_if(F.col("_rule.verdict") == "block").cast("double").alias("bad"))
    counts = stash(counts, "host_seeds")
    edges = stash(host_edges(rows.select(F.col("_node").alias("_host"), "html"), suffixes), "host_edges")
    # both walks go as one, over two copies of the hosts: + for trust, - for distrust, against the links
    named = lambda sign, c: F.concat(F.lit(sign), F.col(c))
    both = edges.select(named("+", "src").alias("src"), named("+", "dst").alias("dst"), "w").union(edges.select(named("-", "dst"), named("-", "src"), "w"))
    seeds = counts.select(named("+", "_host").alias("host"), F.col("good").alias("mass")).union(counts.select(named("-", "_host"), "bad"))
    ranks = walk(both, seeds).groupBy(F.substring("host", 2, 1 << 30).alias("_h"))
    of = lambda sign: F.sum(F.when(F.col("host").startswith(sign), F.col("rank")).otherwise(0.0))
    scores = small(stash(ranks.agg(of("+").alias("trust"), of("-").alias("distrust")), "host_scores"))
    got = rows.drop("html").join(scores, F.col("_node") == F.col("_h"), "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(d - t > threshold, "block").otherwise("allow")
    return got.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), t.alias("trust"), d.alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of judge(): host, path, rule, and the verdicts of rules."""
    got = query(spark, sf_dir)
    return got.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


RULES_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT n, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(verdict, length(r.h || r.p)) AS ruled FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY n)
SELECT page_id, host, path, rule, ruled FROM p LEFT JOIN m USING (n)
"""
