import pytest
from pyspark.sql import functions as F

from evidentia.operators import report, rules, scoring
from evidentia.plans import samples
from evidentia.schemas import OBSERVATIONS

SCHEMA = f"struct<job_id:string,{OBSERVATIONS}>"


def fired(spark, **obs):
    df = spark.createDataFrame([("j", obs.get("file"), obs.get("static"), obs.get("dynamic"), obs.get("network"), obs.get("iocs"))], SCHEMA)
    return {s.id: list(s.evidence) for s in rules.evaluate(df).first().signatures}


def test_nothing_observed_is_clean(spark):
    assert fired(spark) == {}


def test_order_and_evidence(spark):
    got = fired(
        spark,
        file={"family": "pe", "extension": ".scr", "extension_is_dangerous": True},
        static={"pe": {"parsed": True, "sections": [{"name": "UPX0", "entropy": 7.9, "raw_size": 9000, "write_and_execute": True}], "capabilities": {"network": ["send"], "persistence": ["regsetvalue"], "keylogging": ["getkeystate"], "process_injection": ["openprocess"]}, "packer_sections": ["UPX"]}},
        iocs={"urls": [], "domains": ["ddos.example.tk"], "ips": ["45.1.2.3", "10.0.0.1"], "emails": []},
    )
    assert list(got) == ["PE_INJECTION_CAPABLE", "PE_CAPABILITY_MIX", "PE_SELF_MODIFYING", "PE_PACKED", "IOC_SUSPICIOUS_DOMAIN_IN_BINARY", "IOC_HARDCODED_IP_IN_BINARY", "DANGEROUS_EXTENSION", "IOC_SUSPICIOUS_TLD", "PE_UNSIGNED"]
    assert got["PE_PACKED"] == ["known packer sections: UPX", "section UPX0 entropy 7.9"]
    assert got["PE_CAPABILITY_MIX"] == ["capability groups present: keylogging, network, persistence"]
    assert got["IOC_HARDCODED_IP_IN_BINARY"] == ["45.1.2.3"]
    assert got["IOC_SUSPICIOUS_DOMAIN_IN_BINARY"] == ["ddos.example.tk (matches 'ddos')"]


def test_rule_fires_with_empty_evidence(spark):
    assert fired(spark, static={"dde": {"found": True}}) == {"OFFICE_DDE": []}


def test_missing_fields_read_none(spark):
    got = fired(spark, network={"http_requests": [{"kind": "http_connect", "target": "x"}], "dns_queries": [], "connect_attempts": []})
    assert got["DYN_NETWORK"] == ["None None://NoneNone"]


def test_one_flag_is_two_indicators(spark):
    from evidentia import dims
    from evidentia.functions import text as X

    df = spark.createDataFrame([("x -EncodedCommand y",)], "v string")
    hits = df.select(X.keyword_meanings(F.col("v"), dims.POWERSHELL_RISK, "flag")).first()[0]
    assert [h.flag for h in hits] == ["-enc", "-encodedcommand"]


def test_python_rule_error_is_a_finding(spark):
    bad = rules.python_rule("MINE", "mine", 50, "d", lambda o: 1 / 0)
    good = rules.python_rule("YOURS", "yours", 40, "d", lambda o: {"evidence": [o["file"]["family"]]})
    df = spark.createDataFrame([("j", {"family": "pe"}, None, None, None, None)], SCHEMA)
    got = rules.evaluate(df, [bad, good]).first().signatures
    assert [(s.id, s.severity) for s in got] == [("YOURS", 40), ("RULE_ERROR", 0)] and got[0].evidence == ["pe"]


@pytest.mark.parametrize("sev, want", [([80, 55, 55, 45], 90), ([80, 35], 84), ([70, 55, 40, 30], 84), ([70, 60, 55], 85), ([85, 55, 50, 35], 92), ([80, 75, 70, 70, 60, 35], 94), ([65, 50, 45, 35, 30, 20], 82), ([75], 75), ([60], 60), ([20] * 10, 41), ([85], 85)])
def test_published_scores(spark, sev, want):
    assert spark.range(1).select(scoring.score(F.lit(sev))).first()[0] == want


def test_confidence_is_the_rounded_double(spark):
    for sev in ([50], [30], [70, 40], [50, 45, 40], []):
        want = round(min(0.95, 0.35 + 0.45 * max(sev) / 100 + 0.2 * min(sum(s >= 40 for s in sev), 4) / 4), 2) if sev else 0.5
        assert spark.range(1).select(scoring.confidence(F.lit(sev).cast("array<int>") if sev else F.array().cast("array<int>"))).first()[0] == want


def test_report_merges_filters_and_summarises(spark):
    df = spark.createDataFrame(
        [("j", {"name": "a.js", "family": "js", "label": "js script", "size": 3, "extension": ".js", "extension_is_dangerous": True}, {"file_iocs": {"urls": ["http://evil.example.com/a.exe"], "domains": [], "ips": ["127.0.0.1", "192.0.2.9"], "emails": []}}, {"executed": True, "engine": "strace", "tcp_connects": [{"ip": "192.0.2.66", "port": 80}, {"ip": "192.0.2.66", "port": 80}, {"ip": "172.31.240.5", "port": 1}], "exit_code": 0}, {"dns_queries": [{"qname": "a.example"}, {"qname": "a.example"}], "contacted_hosts": ["z", "", "a"]}, None)],
        SCHEMA,
    ).drop("iocs")
    r = report.build(df.withColumn("status", F.lit("timeout"))).first()
    assert r.iocs.ips == ["192.0.2.9", "192.0.2.66"] and r.iocs.domains == ["a.example"]
    assert [(c.ip, c.port) for c in r.network.connect_attempts] == [("192.0.2.66", 80)] and len(r.network.dns_queries) == 1
    assert r.network.contacted_hosts == ["a", "z"]
    assert r.verdict.confidence == 0.4 and "did not complete (timeout)" in r.verdict.summary
    assert "http://" not in r.llm_summary and "hxxp://evil[.]example[.]com/a.exe" in r.llm_summary


def test_archived_observations_can_be_judged_again(spark, tmp_path):
    df = spark.createDataFrame([("j", {"extension_mismatch": "x"}, None, None, None, None)], SCHEMA).drop("iocs")
    df.write.parquet(str(tmp_path / "obs"))
    again = spark.read.parquet(str(tmp_path / "obs"))
    one = report.build(again, [r for r in rules.registry if r.id == "FILE_EXT_MISMATCH"]).first()
    assert one.verdict.score == 45 and one.verdict.level == "suspicious"


def test_conditions_agree_with_evidence(spark):
    """A stated condition holds just where the rule has evidence: on observations that fire every rule, on none, and on halves of them."""
    obs = spark.range(120).select(F.col("id").alias("k"), *samples.observations("id"))
    hole = lambda c, n: F.when(F.col("k") % n != 0, F.col(c)).alias(c)
    empty = [F.lit(None).cast(obs.schema[c].dataType).alias(c) for c in rules._COLUMNS]
    every = obs.union(obs.select("k", hole("file", 2), hole("static", 3), hole("dynamic", 5), hole("network", 7), hole("iocs", 4))).union(obs.limit(1).select("k", *empty))
    said = [rules._evidence(r).isNotNull().alias(f"e{i}") for i, r in enumerate(rules.registry)]
    both = rules.conditions(every, rules.registry, "_on").select("_on", *said).collect()
    assert len(rules.registry) == 51 and len(rules._stated) == 50
    for i, r in enumerate(rules.registry):
        assert [x["_on"][i] for x in both] == [x[f"e{i}"] for x in both], r.id
        assert {x["_on"][i] for x in both} == {True, False}, r.id


def test_fired_is_evaluate_without_texts(spark):
    obs = spark.range(40).select(F.col("id").alias("k"), *samples.observations("id"))
    loud = rules.python_rule("LOUD", "loud", 99, "d", lambda o: ["x"] if o.get("file") else None)
    broken = rules.python_rule("BROKEN", "broken", 50, "d", lambda o: 1 // 0)
    own = rules.Rule("FILE_EXT_MISMATCH", "n", 7, "d", lambda o: F.array(F.lit("always")))  # put in a built-in rule's place
    for chosen in (None, [], [own], rules.registry[:3], [*rules.registry[:2], loud, broken]):
        full = rules.evaluate(rules.fired(obs, chosen), chosen).collect()
        assert all([(s.id, s.severity) for s in r.signatures] == [(s.id, s.severity) for s in r.fired] for r in full)
    assert all(r.fired[0].id == "LOUD" and r.fired[-1].id == "RULE_ERROR" for r in full)
