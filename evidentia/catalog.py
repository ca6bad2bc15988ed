"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions import binary as B
from .functions import tables
from .functions import text as X
from .operators import jobs, network, report, rules, scoring, static, triage
from .plans import samples
from .plans import sql as S
from .schemas import CHILD, DYNAMIC, FLOW_FIELDS, NETWORK, STATIC, ddl
from .streaming import flows as stream
from .streaming import life, places


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


def bytes_of(text):
    """Text as bytes of one character each, as the byte scans read it."""
    return X.latin1(text.cast("binary"))


# ---- indicators
def ioc_ips(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.ips(bytes_of(F.col("text")))).alias("ip"))


def ioc_emails(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.emails(bytes_of(F.col("text")))).alias("email"))


def ioc_domains(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(X.domains(bytes_of(F.concat_ws(" ", "url", "html")))).alias("domain"))


def ioc_urls(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.explode(X.urls(bytes_of(F.concat_ws(" ", "url", "html")))).alias("url"))


def ioc_rollup_by_lang(spark, sf):
    d = docs(spark, sf).select("lang", "doc_id", F.explode(X.ips(bytes_of(F.col("text")))).alias("ip"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"), F.countDistinct("doc_id").alias("docs"))


def ioc_benign_antijoin(spark, sf):
    host = t(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"))
    return host.where((F.col("host") != "") & ~X.is_benign_domain(F.col("host")) & ~F.endswith("host", F.lit(".example.org")))


# ---- content functions
def text_entropy(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(B.letter_entropy("text"), 3).alias("entropy"))


def longest_line(spark, sf):
    return docs(spark, sf).select("doc_id", X.longest_line(F.col("text")).cast("bigint").alias("longest"), X.line_count(F.col("text")).cast("bigint").alias("lines"))


def keyword_hits(spark, sf):
    d = t(spark, sf, "pages").select("page_id", F.explode(X.keyword_hits(F.coalesce("html", F.lit("")), dims.ABUSE_KEYWORDS)).alias("keyword"))
    return d.groupBy("keyword").agg(F.count(F.lit(1)).alias("pages"))


def keyword_count(spark, sf):
    words = ["the", "/a", "script"]
    h = F.coalesce(F.col("html"), F.lit(""))
    return t(spark, sf, "pages").select("page_id", *[X.count_of(h, w).cast("bigint").alias(f"n_{w.strip('/')}") for w in words])


def is_text(spark, sf):
    head = F.substring("text", 1, 65536)
    return docs(spark, sf).select("doc_id", X.is_text(head).alias("is_text"), F.round(F.when(F.length("text") > 0, X.printable_ratio(head)), 6).alias("ratio"))


def script_family(spark, sf):
    return t(spark, sf, "pages").select("page_id", X.script_language(F.coalesce("html", F.lit(""))).alias("family"))


def magic_family(spark, sf):
    family, label = triage.magic(F.col("html").cast("binary"))
    return t(spark, sf, "pages").select("page_id", F.coalesce(family, F.lit("unknown")).alias("family"), F.coalesce(label, F.lit("unknown")).alias("label"))


def ext_and_flags(spark, sf):
    url = F.coalesce(F.regexp_replace("url", "[?#].*$", ""), F.lit(""))
    return t(spark, sf, "pages").select("page_id", triage.extension(url).alias("ext"), triage.extension(url).isin(dims.DANGEROUS_EXTS).alias("dangerous"), F.size(triage.name_flags(url)).cast("bigint").alias("flags"))


def url_rules(spark, sf):
    u = F.coalesce(F.col("url"), F.lit(""))
    iocs = F.struct(F.array(u).alias("urls"), F.array(F.regexp_extract(u, "^https?://([^/?#:]+)", 1)).alias("domains"))
    fires = lambda name: next(r for r in rules.registry if r.id == name).fires({"iocs": F.col("iocs")}).isNotNull()
    seen = t(spark, sf, "pages").select("page_id", iocs.alias("iocs"))
    return seen.select("page_id", fires("IOC_SUSPICIOUS_TLD").alias("bad_tld"), fires("IOC_RAW_IP_URL").alias("raw_ip"), fires("IOC_EXECUTABLE_URL").alias("runs"))


def hashes(spark, sf):
    b = F.col("text").cast("binary")
    return docs(spark, sf).select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


def defang_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.defang(F.col("text")).cast("binary")).alias("defanged"))


def defang_hosts(spark, sf):
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^https?://([^/?#:]+)", 1)
    return t(spark, sf, "pages").select("page_id", X.defang_host(host).alias("host"), X.defang(F.coalesce("url", F.lit(""))).alias("url"))


def strings_runs(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(X.distinct(X.found(bytes_of(F.col("text")), r"([\x20-\x7e]{6,})"), 400)).alias("run"))


def strings_lateral(spark, sf):
    """The same through SQL and a table function."""
    tables.register(spark)
    return spark.sql("SELECT doc_id, s.run FROM {d} AS d, LATERAL printable_strings(CAST(text AS BINARY), 400) AS s", d=docs(spark, sf))


def deobfuscate(spark, sf):
    """Whole texts as joined literals of 60 characters and as one reversed literal; what ends a literal is replaced."""
    text = F.translate("text", '"\n', "' ")
    said = F.concat(F.lit("x = "), F.regexp_replace(text, "(?s)(.{1,60})", '"$1" + '), F.lit('""; y = "'), text, F.lit('".split("").reverse'))
    d = docs(spark, sf).withColumn("s", said)
    return d.select("doc_id", F.array_join(X.joined_literals(F.col("s"), "+", 60, 6), "|").alias("joined"), F.array_join(X.reversed_literals(F.col("s")), "|").alias("reversed"))


def base64_decode(spark, sf):
    said = F.concat(F.lit("run "), F.translate(F.base64(F.col("text").cast("binary")), "\r\n", ""))  # one blob, not lines of 76
    d = docs(spark, sf).select("doc_id", F.explode(B.decoded_blobs(X.base64_blobs(said))).alias("b"))
    return d.select("doc_id", "b.encoded_length", "b.encoding", "b.looks_like_text", "b.entropy", F.md5(F.col("b.decoded_preview").cast("binary")).alias("preview"))


def triage_documents(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("attachment "), F.col("doc_id"), F.lit(".pdf")).alias("name"), F.col("text").cast("binary").alias("content"))
    f = F.col("file")
    return triage.triage(d).select("doc_id", f["size"].alias("size"), f["family"].alias("family"), f["label"].alias("label"), f["extension"].alias("extension"), f["extension_mismatch"].alias("mismatch"), f["sha256"].alias("sha256"), f["head_hex"].alias("head_hex"))


# ---- flows
WINDOW = "INTERVAL 6 HOURS"
#: Seconds that a job of :func:`job_life` may take.
LONGEST = 6 * 3600


def _flow_jobs(spark, sf):
    """A job for each user: the six hours from its first event on."""
    return t(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("started_at")).select(F.col("user_id").alias("job_id"), F.col("user_id").alias("worker_ip"), "started_at", (F.col("started_at") + F.expr(WINDOW)).alias("finished_at"))


def flow_window_join(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", "event_type", F.col("user_id").alias("src"))
    return network.match(e, _flow_jobs(spark, sf)).select("job_id", "event_id", "event_type")


def _collected(spark, sf):
    """Events as flow logs (clicks are look-ups, purchases are requests, views are sessions), collected for each user's job."""
    e, kind = t(spark, sf, "events"), F.col("event_type")
    known = {
        "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        "src": F.col("user_id").cast("string"),
        "kind": F.when(kind == "click", "dns").when(kind == "purchase", "http").otherwise("tcp"),
        "qname": F.when(kind == "click", F.concat(F.lit("d"), F.pmod("event_id", F.lit(50)), F.lit(".example"))),
        "host": F.when(kind == "purchase", F.concat(F.lit("h"), F.pmod("event_id", F.lit(20)), F.lit(".example"))),
        "answer": F.col("event_id").cast("string"),
    }
    flows = e.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ddl(FLOW_FIELDS)], F.col("event_id").alias("_seq"))
    return network.collect(flows, _flow_jobs(spark, sf).withColumn("worker_ip", F.col("worker_ip").cast("string")))


def flow_distinct_first(spark, sf):
    d = _collected(spark, sf).select("job_id", F.explode(network.distinct_queries(F.col("network.dns_queries"))).alias("q"))
    return d.select("job_id", "q.qname", "q.answer")


def flow_split_counts(spark, sf):
    n = F.col("network")
    return _collected(spark, sf).select("job_id", *[F.size(n[f]).cast("bigint").alias(a) for f, a in (("dns_queries", "n_dns"), ("http_requests", "n_http"), ("tcp_sessions", "n_tcp"))])


def contacted_users(spark, sf):
    return _collected(spark, sf).select("job_id", F.array_join("network.contacted_hosts", ",").alias("hosts"))


def _streamed(spark, sf, columns):
    """The events table as a stream, an hour's delay allowed."""
    path = f"{sf}/events.parque[t]"  # a pattern, as a stream's plain path must be a folder and a table may be one file
    return spark.readStream.schema(t(spark, sf, "events").schema).parquet(path).select(*columns).withWatermark("at", "1 hour")


def network_stream(spark, sf):
    """The match of flows with jobs as a join of two streams."""
    work = places.fresh(spark, "network_stream")
    jobs = _flow_jobs(spark, sf)
    jobs.write.parquet(f"{work}/jobs")
    flows = _streamed(spark, sf, ["event_id", "event_type", F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("at")])
    started = spark.readStream.schema(jobs.schema).parquet(f"{work}/jobs").withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    found = stream.interval_joined(flows, started.withWatermark("started_at", "1 hour"), WINDOW.removeprefix("INTERVAL "))
    return stream.finish(found.select("job_id", "event_id", "event_type"), work)


def job_life(spark, sf):
    """A job for each user and day: sign-ups queue it, views start it, purchases and errors end it."""
    kind = F.col("event_type")
    event = F.when(kind == "signup", life.QUEUED).when(kind == "view", life.STARTED).when(kind.isin("purchase", "error"), life.FINISHED)
    job = F.concat_ws("/", "user_id", F.to_date("ts"))
    columns = [job.alias("job_id"), event.alias("event"), F.col("ts").cast("timestamp").alias("at"), F.when(kind == "error", kind).alias("error"), F.lit(None).cast("string").alias("outcome")]
    changes = stream.finish(life.stream(_streamed(spark, sf, columns).where("event IS NOT NULL"), LONGEST), places.fresh(spark, "job_life"), stream.ROCKS)
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("queued_at", "started_at", "ended_at")]
    return life.latest(changes).select("job_id", "status", *times)


# ---- rules and scores
def _severities(spark, sf):
    """A job for each order: its lines' severities, 5 to 85, by part."""
    li = t(spark, sf, "lineitem").select("l_orderkey", (F.pmod("l_partkey", F.lit(17)) * 5 + 5).cast("int").alias("sev"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("sev"), asc=False).alias("sevs"))


def rule_scores(spark, sf):
    return _severities(spark, sf).select("l_orderkey", scoring.score(F.col("sevs")).alias("score"))


def verdict_levels(spark, sf):
    s = rule_scores(spark, sf).select(scoring.level(F.col("score")).alias("level"), "score")
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def confidence(spark, sf):
    return _severities(spark, sf).select("l_orderkey", scoring.confidence(F.col("sevs")).alias("confidence"))


def _fired(spark, sf):
    """The rules that fire on observations made to order for each order's number."""
    return rules.fired(t(spark, sf, "orders").select("o_orderkey", *samples.observations("o_orderkey")))


def rules_fired(spark, sf):
    return scoring.judge(_fired(spark, sf), "fired").select("o_orderkey", F.array_join("fired.id", ",").alias("ids"), "score", "level", "confidence")


def signature_topk(spark, sf):
    d = _fired(spark, sf).select("o_orderkey", F.posexplode(F.slice("fired", 1, 3)).alias("k", "s"))
    return d.select("o_orderkey", (F.col("k") + 1).cast("bigint").alias("rank"), F.col("s.id").alias("id"), F.col("s.severity").alias("severity"))


def rule_list(spark, sf):
    """All rules, and for how many orders' observations each fires."""
    hits = _fired(spark, sf).select(F.explode("fired.id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("orders"))
    return rules.catalogue(spark).join(hits, "id", "left").select("id", "name", "severity", "description", F.coalesce("orders", F.lit(0)).alias("orders"))


def observed(spark, sf, table="pages"):
    """Observations of pages as if they were attachments: named by their url, indicators from their text."""
    p = t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("job_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    body = bytes_of(F.concat_ws(" ", "url", "html"))
    file = F.struct(F.col("url").alias("name"), F.lit("text").alias("family"), triage.extension(F.col("url")).alias("extension"), F.lit(None).cast("string").alias("extension_mismatch"), triage.extension(F.col("url")).isin(dims.DANGEROUS_EXTS).alias("extension_is_dangerous"), triage.name_flags(F.col("url")).alias("filename_flags"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("size"), F.lit("plain text").alias("label"))
    found = F.struct(F.lit("generic").alias("engine"), X.iocs(body).alias("file_iocs"), (X.longest_line(F.col("html")) > 1000).alias("single_line_obfuscation"), X.longest_line(F.col("html")).alias("longest_line"))
    p = p.withColumn("file", file).withColumn("s", found)
    fill = lambda kind, src, names: F.struct(*[(F.col(f"{src}.{f.name}") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in ddl(f"x:{kind}")[0].dataType])
    return p.select("job_id", "file", fill(STATIC, "s", {"engine", "file_iocs", "single_line_obfuscation", "longest_line"}).alias("static"), F.lit(None).cast(DYNAMIC).alias("dynamic"), F.lit(None).cast(NETWORK).alias("network"))


def page_reports(spark, sf):
    r = report.build(observed(spark, sf))
    v = F.col("verdict")
    return r.select(F.col("job_id").cast("bigint").alias("page_id"), v["score"].alias("score"), v["level"].alias("level"), F.size("signatures").cast("bigint").alias("fired"))


def flagship(spark, sf):
    return page_reports(spark, sf).orderBy(F.desc("score"), "page_id")


# ---- jobs
def job_listing(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return jobs.listing(o, 50)


def job_retention(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("modified_at"))
    return jobs.expired(o, F.lit("1998-01-01 00:00:00").cast("timestamp")).groupBy(F.year("modified_at").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def child_rollup(spark, sf):
    """Lines of an order as the children of an archive."""
    child = {"name": F.col("l_linenumber").cast("string"), "depth": F.col("l_linenumber"), "family": F.when(F.col("l_linestatus") == "O", "pe").otherwise("text"), "dangerous": F.col("l_returnflag") == "R"}
    row = F.struct(*[child.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ddl(f"c:{CHILD}")[0].dataType])
    kids = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("children"))
    depth, runs, nested = static.child_facts(F.col("children"))
    return t(spark, sf, "orders").join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", depth.alias("depth"), runs.alias("runs"), nested.alias("nested"))


QUERIES = [ioc_ips, ioc_emails, ioc_domains, ioc_urls, ioc_rollup_by_lang, ioc_benign_antijoin, text_entropy, longest_line, keyword_hits, keyword_count, is_text, script_family, magic_family, ext_and_flags, url_rules, hashes, defang_text, defang_hosts, strings_runs, strings_lateral, deobfuscate, base64_decode, triage_documents, flow_window_join, flow_distinct_first, flow_split_counts, contacted_users, network_stream, job_life, rule_scores, verdict_levels, confidence, signature_topk, rules_fired, rule_list, page_reports, job_listing, job_retention, child_rollup]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return S.oracles()
