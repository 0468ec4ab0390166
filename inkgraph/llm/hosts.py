"""URL filters: explicit rules, and elsewhere the empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.llm.shared import join_hot, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which names are registered, as in the public list of suffixes, for the
#: countries that register most; a caller gives the full list in their place.
SUFFIXES = """
ac.id ac.il ac.in ac.jp ac.kr ac.nz ac.th ac.uk ac.za ad.jp asn.au co.at co.id co.il co.in co.jp co.ke co.kr co.nz co.th
co.uk co.za com.ar com.au com.bd com.br com.cn com.co com.ec com.eg com.gr com.hk com.mx com.my com.ng com.pe com.ph
com.pk com.pl com.pt com.py com.sa com.sg com.tr com.tw com.ua com.uy com.ve com.vn ed.jp edu.ar edu.au edu.br edu.cn
edu.co edu.hk edu.mx edu.my edu.pe edu.ph edu.pk edu.pl edu.sg edu.tr edu.tw edu.vn firm.in gen.in go.id go.jp go.kr
go.th gob.ar gob.mx gob.pe gov.ar gov.au gov.br gov.cn gov.hk gov.il gov.in gov.my gov.ph gov.pk gov.pl gov.sg gov.tr
gov.tw gov.ua gov.uk gov.vn gov.za govt.nz gr.jp gv.at id.au ind.br ind.in lg.jp ltd.uk me.uk ne.jp net.ar net.au net.br
net.cn net.hk net.in net.mx net.nz net.pl net.tr net.tw net.ua net.uk nhs.uk or.at or.id or.jp or.kr or.th org.ar org.au
org.br org.cn org.hk org.il org.in org.mx org.my org.nz org.pe org.ph org.pk org.pl org.sg org.tr org.tw org.ua org.uk
org.vn org.za plc.uk police.uk res.in sch.uk web.id
""".split()
#: Standard deviations of the posterior between its mean and the bound, and the bound from which a page is blocked.
Z, BLOCK_FROM = 1.645, 0.5
#: Limits of a level's intraclass correlation.
RHO = (0.001, 0.999)


def split_url(pages: DataFrame, url_col: str = "url", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``pages`` with host, path, domain and suffix. Suffix: the longest of ``suffixes`` that the host's name, without
    user and port, ends with or is, else its last label. Domain: the suffix and the label before it, if there is one;
    an address in numbers is its own suffix and domain."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    out = pages.withColumns({"path": path, "host": F.translate(host, UPPER, LOWER)})
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    number = name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")
    labels = F.when(number, 1)
    for n in sorted({s.count(".") + 1 for s in suffixes} - {1}, reverse=True):
        labels = labels.when(F.substring_index(name, ".", -n).isin([s for s in suffixes if s.count(".") + 1 == n]), n)
    labels = labels.otherwise(1)
    parts = F.split(name, r"\.")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    return out.withColumns({"domain": F.when(number, name).otherwise(tail(labels + 1)), "suffix": F.when(number, name).otherwise(tail(labels))})


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (host, path) with rule and rule_verdict: those of the longest rule that fits, else null."""
    chain = rule = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        chain = F.when(fits, verdict) if chain is None else chain.when(fits, verdict)
    null = F.lit(None).cast("string")
    return pages.withColumns({"rule": null if rule is None else rule, "rule_verdict": null if chain is None else chain})


def _shrunk(level: DataFrame, raw: str) -> DataFrame:
    """Prior strength 1 / rho - 1 of a level from the rates (k of n) of its groups around their parents' rate ``raw``:
    rho from Pearson's statistic, whose mean is the sum of 1 + (n - 1) rho for beta-binomial counts."""
    n, k, p = F.col("n"), F.col("k"), F.col(raw)
    chi = F.sum(F.when(n > 0, (k - n * p) * (k - n * p) / (n * p * (1 - p))))
    # no group of two or more outcomes tells no spread
    rho = (chi - F.sum((n > 0).cast("long"))) / F.nullif(F.sum(F.when(n > 0, n - 1)), F.lit(0))
    rho = F.greatest(F.least(F.coalesce(rho, F.lit(0.5)), F.lit(RHO[1])), F.lit(RHO[0]))
    return level.agg((1 / rho - 1).alias("strength"))


def reputations(pages: DataFrame, outcome_col: str = "bad") -> DataFrame:
    """(host, n, k, mean, bound, pages) of each host of ``pages`` (host, domain, suffix, outcome 0, 1 or null).

    Counts are shrunk from host to registered domain to suffix to all pages, each level's prior being beta with the
    mean of the level above and a strength fitted to the level's spread. bound: the posterior's lower end for the
    share of bad pages. Counts combine before each shuffle; a host that holds most pages costs no task more.
    """
    bad = F.col(outcome_col)
    hosts = pages.groupBy("suffix", "domain", "host").agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("k"), F.count("*").alias("pages"))
    hosts = materialize(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    raw = lambda: ((F.col("k") + 0.5) / (F.col("n") + 1)).alias("raw")
    top = total.select(raw())
    suffix_raw, domain_raw = suffixes.select("suffix", raw()), domains.select("domain", raw())
    suffix_m = _shrunk(suffixes.crossJoin(F.broadcast(top)), "raw")
    domain_m = _shrunk(domains.join(suffix_raw, "suffix"), "raw")
    host_m = _shrunk(hosts.join(domain_raw, "domain"), "raw")
    shrink = lambda mean: (F.col("k") + F.col("strength") * F.col(mean)) / (F.col("n") + F.col("strength"))
    # the right sides of these cross joins are one row each
    s = suffixes.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(suffix_m)).select("suffix", shrink("raw").alias("s_mean"))
    d = domains.join(s, "suffix").crossJoin(F.broadcast(domain_m)).select("domain", shrink("s_mean").alias("d_mean"))
    h = hosts.join(d, "domain").crossJoin(F.broadcast(host_m))
    mean, size = shrink("d_mean"), F.col("n") + F.col("strength")
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (size + 1))
    return h.select("host", "n", "k", mean.alias("mean"), bound.alias("bound"), "pages")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
    outcome_col: str | None = None, suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of every row of ``pages``.

    A page that a rule fits has the rule's verdict. Others are blocked where the posterior bound of their host's
    share of bad pages reaches BLOCK_FROM. Labelled outcomes are ``outcome_col`` (1 bad, 0 good, null none) or, without
    one, the rules' own verdicts. Null urls and those without ``://`` have an empty host and path, fit no rule and
    share the reputation of the empty host. Repeated rows stay; other columns are not looked at.
    """
    own = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url")]
    own += [F.col(outcome_col).cast("int").alias("bad")] if outcome_col else []
    rows = with_rules(split_url(pages.select(*own), suffixes=suffixes), rules).drop("url")
    if not outcome_col:
        rows = rows.withColumn("bad", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0))
    known = materialize(reputations(rows).select("host", "bound", "pages"), "reputations")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bound") >= BLOCK_FROM, "block").otherwise("allow"))
    return join_hot(rows, known, "host", count="pages").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")
