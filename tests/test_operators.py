"""Operators on the literal cases, one row at a time."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from guardframe.functions import strings
from guardframe.operators import activation, detect, metrics, outcomes, policy, redact, requests, responses, scoring, tokenizers, toolgate
from guardframe.plans import config, fixtures as X
from guardframe.plans.config import Category, Guard, Legacy, Security, ToolGate
from guardframe.sources import tables
from guardframe.streaming import sinks


def one(spark, schema, *values):
    return spark.createDataFrame([values], schema)


@pytest.mark.parametrize(
    "text, entities, expected",
    [
        ("card 5500 0000 0000 0004 ok", detect.Entities(), "card [REDACTED_PHONE] ok"),
        ("card 5500 0000 0000 0004 ok", detect.Entities(phone=False), "card [[REDACTED_TOKEN]] ok"),
        ("IBAN GB29NWBK60161331926819", detect.Entities(), "IBAN GB29NWBK[REDACTED_PHONE]"),
        ("the code is key-demo-zyxwvutsrqponmlkjihg", detect.Entities(), "the code is [REDACTED_TOKEN]"),
    ],
)
def test_redaction_order(spark, text, entities, expected):
    assert one(spark, "t string", text).select(redact.pii(F.col("t"), entities)).first()[0] == expected


@pytest.mark.parametrize("case", X.TOOL_CALLS[:25], ids=lambda c: c[0])
def test_each_shell_rule_blocks_its_case(spark, case):
    found = toolgate.judge(spark.createDataFrame([case], "id string, name string, type string, args string"), ToolGate()).first()
    assert found["action"] == "block" and case[0] in [h["rule_id"] for h in found["hits"]]


def test_tool_gate_switches(spark):
    calls = spark.createDataFrame(X.TOOL_CALLS, "id string, name string, type string, args string")
    assert {r["action"] for r in toolgate.judge(calls, ToolGate(enabled=False)).collect()} == {"allow"}
    allowed = toolgate.judge(calls.where("id = 'rm_rf_root'"), ToolGate(commands=("cd / && rm -Rf /*",))).first()
    assert allowed["action"] == "allow" and allowed["primary"] is None
    empty_first = toolgate.judge(calls.where("id = 'empty_first'"), ToolGate()).first()
    assert empty_first["action"] == "allow"


def test_guard_modes(spark):
    df = spark.createDataFrame(X.GUARD_CASES, "id string, text string")
    assert {r["id"]: r["decision"] for r in toolgate.guard(df, Guard()).collect()}["dotall"] == "warn"
    assert {r["decision"] for r in toolgate.guard(df, Guard(mode="ignore")).collect()} == {"allow"}
    quiet = toolgate.guard(df.where("id = 'upload'"), Guard(overrides={"data_exfil_instruction": "ignore"})).first()
    assert quiet["decision"] == "allow" and quiet["note"] == ""


def test_log_redaction(spark):
    found = {r[0]: r[1] for r in spark.createDataFrame(X.LOG_CASES, "id string, t string").select("id", redact.log_line(F.col("t"))).collect()}
    assert found["list"] == "api_keys=[REDACTED]" and "sk-secret-123" not in found["auth"]
    assert found["url"] == "manifest_url=https://example.com/manifest.json"
    for hidden in ("abc", "supersecret", "anotherone", "ACME-FREE-AAAA", "files/base/"):
        assert hidden not in found["many"]
    assert "https://lic.example.test/[REDACTED_PATH]" in found["many"] and "pw" not in found["userinfo"]


def test_merge_ladder(spark):
    signals = "array<struct<category:string,source:string,confidence:float,evidence:string>>"
    df = spark.createDataFrame(
        [
            ("regex", [("prompt_injection", "regex", 1.0, None), ("prompt_injection", "ml:x", 0.1, None)]),
            ("block", [("jailbreak", "ml:x", 0.8, None)]),
            ("warn", [("jailbreak", "ml:x", 0.6, None)]),
            ("none", [("jailbreak", "ml:x", 0.59, None), ("injection", "regex", 1.0, None)]),
            ("alias", [("data_exfil_attempt", "ml_v1", 0.75, None)]),
            ("ner", [("contains_personal_data", "ner:pii", 0.5, None)]),
        ],
        f"id string, s {signals}",
    )
    found = {r[0]: [(h["category"], h["action"], round(h["confidence"], 3), h["sources"]) for h in r[1]] for r in df.select("id", policy.merged_hits(F.col("s"), Security())).collect()}
    assert found["regex"] == [("prompt_injection", "block", 1.0, ["regex", "ml:x"])]
    assert found["block"] == [("jailbreak", "block", 0.8, ["ml:x"])]
    assert found["warn"] == [("jailbreak", "warn", 0.6, ["ml:x"])]
    assert found["none"] == []
    assert found["alias"] == [("data_exfil", "block", 0.75, ["ml_v1"])]
    assert found["ner"] == [("pii", "log", 0.5, ["ner:pii"])]


def test_model_scores_and_spans(spark):
    cfg = Security(prompt_injection=Category(warn=0.5, block=0.8, regex_enabled=False), pii=Category(warn=0.5, block=0.0, regex_enabled=False, on_ml="redact"), secrets=Category(regex_enabled=False))
    schema = "text string, scores map<string,float>, spans array<struct<entity_type:string,start_byte:int,end_byte:int>>"
    df = one(spark, schema, "hello kims@example.net", {"prompt_injection": 0.95, "contains_personal_data": 1.0}, [("EMAIL", 6, 22)])
    row = policy.before_model(df, cfg, Legacy(), scores="scores", entities="spans").first()
    assert row["blocked"] and row["content"] == "hello [REDACTED_EMAIL]"
    assert [h["category"] for h in row["decisions"]] == ["prompt_injection", "pii"]


def test_finals(spark):
    hit = "array<struct<category:string,action:string>>"
    df = one(spark, f"d string, h {hit}", "allow", [("secrets", "block_and_redact")])
    assert df.select(activation.request_final(F.col("d"), F.col("h"))).first()[0] == "redact"
    final = lambda d, mode, post, checked, note: spark.range(1).select(activation.response_final(F.lit(d), F.lit(mode), F.lit(post), F.lit(checked), F.lit(note)).alias("x")).select("x.*").first()
    assert tuple(final("error_provider", "non_stream", "", False, None)) == ("block", None)
    assert tuple(final("allow", "stream", "redacted", True, None)) == ("allow", "redaction_suggested")
    assert tuple(final("allow", "non_stream", "redacted", True, None)) == ("redact", "redaction_applied")
    assert tuple(final("allow", "non_stream", "allow", True, "unsafe_instruction_detected")) == ("warn", "unsafe_instruction_detected")
    assert tuple(final("allow", "non_stream", "allow", False, None)) == ("allow", "skipped")
    assert tuple(final("allow", "non_stream", "allow", True, None)) == ("allow", None)


def test_attack_class():
    assert scoring.attack_class("prompt_injection", {0: "safe", 1: "prompt_injection"}) == 1
    assert scoring.attack_class("jailbreak", {0: "unsafe", 1: "other"}) == 1  # a label that holds "safe" gives the other one
    assert scoring.attack_class("x", {0: "LABEL_0", 1: "LABEL_1"}) == 1
    assert scoring.attack_class("x", {0: "bad", 1: "benign"}) == 0


def test_word_piece():
    t = tokenizers.WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "ab": 4, "##c": 5, "##cd": 6, "é": 7}, tokenizers.Special(2, 3, 0, 1))
    assert t.encode("ABCD é abx", 8) == ([2, 4, 6, 7, 1, 3, 0, 0], [1] * 6 + [0] * 2)
    assert t.encode("ab ab ab ab ab", 4)[0] == [2, 4, 4, 3] and t.encode("", 3) == ([2, 3, 0], [1, 1, 0])
    assert t.offsets("é abcd") == [(7, 0, 2), (4, 3, 5), (6, 5, 7)]


def test_word_piece_keeps_the_tail():
    t = tokenizers.WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "##b": 5, "##c": 6}, tokenizers.Special(2, 3, 0, 1))
    assert t.encode("abc abc", 4)[0] == [2, 5, 6, 3]


def test_unigram():
    special = tokenizers.Special(1, 2, 0, 0)
    t = tokenizers.Unigram([("<unk>", -10.0), ("<s>", 0.0), ("</s>", 0.0), ("▁ab", -1.0), ("▁a", -0.4), ("b", -0.4), ("c", -1.0)], special, False)
    assert t.tokenize("ab") == [4, 5] and t.tokenize("ab c") == [4, 5, 0, 0, 0, 6]  # an unknown for each byte of the blank
    assert t.tokenize("  ") == [] and t.encode("ab", 3)[0] == [1, 4, 5]
    dead = tokenizers.Unigram([("▁abx", -1.0), ("▁ab", -1.0)], tokenizers.Special(-1, -1, 0, -1), False)
    assert dead.tokenize("abc") == []


def test_requests(spark):
    df = spark.createDataFrame(X.BEARER_CASES, "id string, h string")
    assert {r[0]: r[1] for r in df.select("id", requests.bearer_token(F.col("h"))).collect() if r[1]} == {"ok": "abc123", "low": "xyz"}
    keys = spark.createDataFrame([("k", "a", "x"), ("k", "b", "x"), ("l", "c", "x")], "api_key string, project_id string, provider string")
    assert [r["api_key"] for r in requests.repeated_keys(keys).collect()] == ["k"]
    assert [r[0] for r in spark.createDataFrame([(" User",), ("",), (None,)], "r string").select(requests.normalized_role(F.col("r"))).collect()] == ["user"] * 3


def test_bodies(spark):
    df = spark.createDataFrame([('{"model":"m","messages":[{"role":"user","content":"hi"}]}',), ("nope",), ("[1]",), ("{" + " " * 99 + "}",)], "body string")
    assert [r["status"] for r in tables.chat_requests(df, "body", 90).collect()] == [200, 400, 400, 413]


def test_config_layers():
    cfg = config.load(text='{"legacy": {"pii": "redact", "entities": {"email": false, "phone": false, "credit_card": false, "iban": false, "tokens": false}}, "security": {"pii": {"warn": 0.9}}}')
    assert cfg.legacy.pii == "redact" and cfg.legacy.entities == detect.Entities()
    assert cfg.security.pii.warn == 0.9 and cfg.security.pii.on_regex == "redact"
    missing = config.load("/does/not/exist.yaml")
    assert not any(vars(missing.legacy.entities).values()) and config.problems(missing) == config.problems(cfg) == []
    assert config.load(text="{}") == config.Config()
    assert config.problems(config.load(text='{"guard": {"mode": "block"}, "limits": {"messages": 0}}')) == ["guard.mode must be warn or ignore", "limits.messages must be positive"]


FAULTS = [
    ('{"addr": " "}', "addr must be set"),
    ('{"providers": {}}', "at least one provider must be configured"),
    ('{"default_provider": ""}', "default_provider must be set"),
    ('{"default_provider": "x"}', "default_provider 'x' isn't a provider"),
    ('{"providers": {"echo": {}}}', "provider 'echo' has no type"),
    ('{"providers": {"echo": {"type": "OpenAI"}}}', "provider 'echo' has no api key"),
    ('{"providers": {"echo": {"type": "x", "base_url": "nothing"}}}', "provider 'echo' has an invalid base_url"),
    ('{"providers": {"echo": {"type": "x", "base_url": "ftp://h.example"}}}', "provider 'echo' base_url must be http or https"),
    ('{"providers": {"echo": {"type": "x", "base_url": "http://[::ffff:10.0.0.1]:80/"}}}', "provider 'echo' base_url is in a private network"),
    ('{"projects": []}', "at least one project must be configured"),
    ('{"projects": [{"id": ""}]}', "a project's id must be set"),
    ('{"projects": [{"id": "a", "provider": "x", "api_keys": ["k"]}]}', "project 'a' names an unknown provider 'x'"),
    ('{"projects": [{"id": "a"}]}', "project 'a' must have an api key"),
    ('{"projects": [{"id": "a", "api_keys": ["k"]}, {"id": "b", "api_keys": ["k"]}]}', "an api key is that of the projects 'a' and 'b'"),
    ('{"sinks": [{"type": "file_jsonl"}]}', "sink 0 (file_jsonl) has no path"),
    ('{"sinks": [{"type": "webhook"}]}', "sink 0 (webhook) has no url"),
    ('{"sinks": [{"type": "webhook", "url": "nothing"}]}', "sink 0 (webhook) has an invalid url"),
    ('{"sinks": [{"type": "webhook", "url": "ftp://h.example"}]}', "sink 0 (webhook) url must be http or https"),
    ('{"sinks": [{"type": "x"}]}', "sink 0 has unknown type 'x'"),
    ('{"telemetry": {"enabled": true}}', "telemetry is enabled but has no endpoint"),
    ('{"telemetry": {"enabled": true, "endpoint": "e", "protocol": "udp"}}', "telemetry.protocol must be grpc or http"),
    ('{"tool_gate": {"mode": "none"}}', "tool_gate.mode must be elevated_only or all_tools"),
    ('{"guard": {"overrides": {"data_exfil_instruction": "block"}}}', "guard.overrides.data_exfil_instruction must be warn or ignore"),
    ('{"security": {"pii": {"warn": 2}}}', "security.pii.warn must be between 0 and 1"),
    ('{"legacy": {"pii": "x"}}', "legacy.pii must be one of block, log, ignore, redact"),
    ('{"preview_level": "x"}', "preview_level must be full, redacted or metadata"),
]


@pytest.mark.parametrize("text, fault", FAULTS)
def test_config_problems(text, fault):
    assert config.problems(config.load(text=text))[0] == fault


def test_specialists_file(tmp_path):
    (tmp_path / "s.yaml").write_text('{"specialists": {"jailbreak": {"kind": "sequence", "onnx": "m.onnx", "max_tokens": 128}, "pii_ner": null}}')
    assert config.specialists(str(tmp_path / "s.yaml")) == {"jailbreak": config.Specialist("sequence", "m.onnx", "", 128), "pii_ner": config.Specialist()}
    for path in ("", str(tmp_path / "no.yaml")):
        with pytest.raises((ValueError, OSError)):
            config.specialists(path)
    assert [config.parse_action(x, "log") for x in (" Block ", "", None, "x")] == ["block", "log", "log", "log"]
    assert tables.thresholds('{"thresholds": {"jailbreak": {"warn": 0.5, "block": null}, "x": null}}') == {"jailbreak": {"warn": 0.5}, "x": {}}
    (tmp_path / "l.json").write_text('{"id2label": {"0": "O", "1": "B-NAME"}}')
    assert tables.label_map(str(tmp_path / "l.json")) == {0: "O", 1: "B-NAME"}


def test_outcomes(spark):
    error = lambda name, path: tuple(spark.range(1).select(outcomes.http_error(F.lit(name), F.lit(path)).alias("e")).select("e.*").first())
    assert error("policy", "chat") == (403, "policy_error", None) and error("policy", "responses") == (403, "acme_policy_violation", "policy_blocked")
    assert error("provider", "chat") == (502, "provider_error", None) and error("ok", "chat") == (None, None, None)
    texts = spark.createDataFrame([("Dial TCP: refused",), ("unauthorized",), ("odd",), (None,)], "e string")
    assert [tuple(r) for r in texts.select(outcomes.network_like(F.col("e")), outcomes.fallback_reason(F.col("e"))).collect()] == [(True, "validate_failed_network"), (False, "invalid_license"), (False, "validate_failed"), (False, "validate_failed_network")]
    families = spark.createDataFrame([(" /a/b/ ",), ("",), (None,)], "f string")
    assert [r[0] for r in families.select(outcomes.bundle_family(F.col("f"))).collect()] == ["a/b", "guard_v1", "guard_v1"]
    assert families.select(outcomes.bundle_family_variants(F.col("f"))).first()[0] == ["a/b", "a/b/", "a/b//"]
    keys = spark.createDataFrame([(" acme-free-xxxx",), ("",), (None,), ("ACME-PAID-1",)], "k string")
    assert [r[0] for r in keys.select(outcomes.placeholder_key(F.col("k"))).collect()] == [True, True, True, False]
    assert outcomes.readiness(True, 1, 1, False, False, True) == {"status": "ready", "mode": "regex_only", "reason": ""}
    assert [outcomes.readiness(*x)["reason"] for x in ((False, 0, 0, True, False, False), (True, 0, 0, True, False, False), (True, 1, 0, True, False, False), (True, 1, 1, True, False, False))] == ["config_not_loaded", "no_providers_configured", "no_projects_configured", "ml_inactive"]
    assert outcomes.readiness(True, 1, 1, True, True, False)["mode"] == "ml"
    assert [outcomes.setting(*x) for x in ((3, "5", 1), (0, " 5", 1), (0, "x", 1), (0, None, 1))] == [(3, "yaml"), (5, "env"), (1, "default"), (1, "default")]
    assert outcomes.provider_key("K", " own ", {"K": " env "}) == "env" and outcomes.provider_key("", " own ", {}) == "own"
    assert outcomes.provider_url("OpenAI", "") == "https://api.openai.com/v1" and outcomes.provider_url("x", " u ") == "u"
    codes = spark.createDataFrame([(401,), (500,), (404,), (200,)], "s int").select(activation.licence_outcome(F.col("s")))
    assert [r[0] for r in codes.collect()] == ["invalid_license", "network_error", "other_error", None]
    ways = spark.createDataFrame([(True, "", True, True), (False, "v", True, False), (False, "", True, True), (False, " ", True, False), (False, None, False, False)], "v boolean, n string, m boolean, r boolean")
    assert [r[0] for r in ways.select(activation.bundle_fallback(F.col("v"), F.col("n"), F.col("m"), F.col("r"))).collect()] == ["ml", "ml", "regex_only", "error", "disabled_ml"]


def test_scalars(spark):
    row = spark.range(1).select(
        strings.rfc3339(F.lit("2024-05-06 07:08:09").cast("timestamp")),
        strings.rfc3339(F.lit("2024-05-06 07:08:09.120").cast("timestamp")),
        strings.millis(F.lit(1_234_567)),
        strings.millis_of_whole_micros(F.lit(1_234_567)),
        strings.short_hash(F.lit(" key ")),
        strings.short_hash(F.lit(None)),
        F.length(strings.random_id()),
        requests.is_true(F.lit(" Yes")),
        requests.is_true(F.lit("0")),
    ).first()
    assert tuple(row) == ("2024-05-06T07:08:09Z", "2024-05-06T07:08:09.12Z", 1.234567, 1.234, "2c70e12b", "", 32, True, False)
    hosts = ["::ffff:10.0.0.1", "[::ffff:0a00:0001]:80", "::ffff:8.8.8.8", "::ffff:0808:0808", "0:0:0:0:0:ffff:127.0.0.1", "fcab::1", "2001:db8::1", "localhost:1"]
    found = {r[0]: r[1] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", activation.private_host(F.col("h"))).collect()}
    assert found == {h: config.private_address(h) for h in hosts}


def test_tool_executor(spark):
    calls = spark.createDataFrame(X.TOOL_CALLS, "id string, name string, type string, args string").where("id in ('sudo_usage', 'chain', 'plain', 'fs_shadow')")
    hits, errors, allowed = toolgate.execute(calls, ToolGate(mode="all_tools"))
    assert sorted((r["id"], r["rule_id"], r["action"]) for r in hits.collect()) == [("chain", "netcat_exfil", "block"), ("chain", "sudo_usage", "warn"), ("chain", "systemd_enable", "warn"), ("fs_shadow", "read_sensitive_files", "block"), ("sudo_usage", "sudo_usage", "warn")]
    assert sorted(map(tuple, errors.collect())) == [("chain", "acme_tool_policy_violation", "tool_blocked", "netcat_exfil", "data_exfil"), ("fs_shadow", "acme_tool_policy_violation", "tool_blocked", "read_sensitive_files", "data_exfil")]
    assert allowed.columns == calls.columns and sorted(r["id"] for r in allowed.collect()) == ["plain", "sudo_usage"]
    assert toolgate.rule_pattern("(", True, instead="a+") == "a+" and toolgate.rule_pattern("(", False) == toolgate.NEVER
    assert spark.createDataFrame([("any\ntext",), ("",)], "t string").where(strings.matches(F.col("t"), toolgate.NEVER)).count() == 0
    assert len(toolgate.rules()) == 25 and len(toolgate.rules(False)) == 27


def test_guard_hits_of_an_event(spark):
    """The first hit of each category, its score, the log line and the header."""
    hit = "array<struct<rule_id:string,category:string,action:string,confidence:float,sources:array<string>,evidence:string>>"
    decision = "array<struct<category:string,action:string,confidence:float,sources:array<string>>>"
    row = ("", "p", "echo", "m", "mail a@b.co", "out", False, [], "allow", "unsafe_instruction_detected", [("r1", "data_exfil_instruction", "warn", 1.0, ["s"], "first"), ("r2", "Data_Exfil_Instruction", "warn", 1.0, ["s"], "second"), ("r3", "unsafe_action_instruction", "warn", 0.0, [], "")])
    df = one(spark, f"request_id string, project_id string, provider string, model string, prompt string, output string, blocked boolean, decisions {decision}, post_decision string, note string, guard_hits {hit}", *row)
    events = activation.events(df, "STREAM ", engine=activation.Engine(included=True), now=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    event = json.loads(events.select(activation.event_line(events)).first()[0])
    assert [(h["category"], h.get("evidence"), "sources" in h, "confidence" in h) for h in event["response"]["hits"]] == [("data_exfil_instruction", "first", True, True), ("unsafe_action_instruction", None, False, False)]
    assert event["response"]["scores"] == {"data_exfil_instruction": 1.0} and event["summary"] == {"request_final": "allow", "response_final": "warn", "response_note": "unsafe_instruction_detected", "blocked": False, "categories": ["data_exfil_instruction", "unsafe_action_instruction"]}
    assert event["timestamp"] == "2024-01-02T03:04:05Z" and len(event["request_id"]) == 32 and event["meta"]["mode"] == "stream"
    assert event["intel"] == {"status": "", "cache_present": False, "model_engine": {"status": "", "bundle_version": "", "model": "guard_v1"}} and event["request"]["preview"] == {"prompt": "mail [REDACTED_EMAIL]"}
    assert "\n" not in events.select(sinks.response_header(events)).first()[0]


def test_quantiles_of_large_groups(spark):
    import random

    rng = random.Random(1)
    rows = [("a", rng.choice([1.5, rng.random() * 1000, -rng.random()])) for _ in range(3000)] + [("b", 2.0)] * 50 + [("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for most in (10, 100_000):
        found = {r["g"]: r for r in metrics.nearest_rank(df, "v", (0.0, 0.5, 0.95), ["g"], most).collect()}
        assert sorted(found) == ["a", "b", "d"]
        for g in found:
            own = sorted(v for h, v in rows if h == g)
            assert [found[g][f"p{k}"] for k in (0, 50, 95)] == [own[int(len(own) * s)] for s in (0.0, 0.5, 0.95)]
            assert abs(found[g]["avg"] - sum(own) / len(own)) < 1e-9


def test_offsets_have_a_length(tmp_path):
    t = tokenizers.WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "##b": 5, "##c": 6}, tokenizers.Special(2, 3, 0, 1))
    assert t.encode_with_offsets("abc abc", 4) == ([2, 4, 5, 3], [1] * 4, [(-1, -1), (0, 1), (1, 2), (-1, -1)])  # stops inside the word
    assert t.encode_with_offsets("é a", 6) == ([2, 1, 4, 3, 0, 0], [1, 1, 1, 1, 0, 0], [(-1, -1), (0, 2), (3, 4), (-1, -1), (-1, -1), (-1, -1)])
    assert t.encode_with_offsets("a", 0) == ([], [], []) and t.encode_with_offsets("a a", 1)[0] == [2]
    (tmp_path / "vocab.txt").write_text("[PAD]\n\n[UNK]\n[CLS]\n[SEP]\na\n")
    read = tokenizers.from_file(str(tmp_path))
    assert read.encode("a", 4)[0] == [2, 4, 3, 0]
    model = {"type": "Unigram", "unk_id": 1, "byte_fallback": True, "vocab": [["[PAD]", 0.0], ["<unk>", -9.0], ["▁a", -1.0], ["<0x62>", -5.0]]}
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": model, "post_processor": {"special_tokens": {"[CLS]": {"ids": [7]}}}}))
    unigram = tokenizers.from_file(str(tmp_path))  # before vocab.txt
    assert unigram.special == tokenizers.Special(7, -1, 0, 1) and unigram.encode("ab", 4)[0] == [7, 2, 3, 0]
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": [{"token": "[CLS]", "id": 9}, {"token": "a"}]}}))
    assert tokenizers.from_file(str(tmp_path / "tokenizer.json")).ids == {b"[CLS]": 9, b"a": 1}
    with pytest.raises(ValueError):
        (tmp_path / "tokenizer.json").write_text("{}")
        tokenizers.from_file(str(tmp_path / "tokenizer.json"))


def test_specialists_keep_what_others_found(spark):
    piece = lambda: tokenizers.WordPiece({"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "bad": 4, "ann": 5}, tokenizers.Special(2, 3, 0, 1))

    def broken(ids, masks):
        raise RuntimeError("no session")

    sequence = lambda ids, masks: [[-2.0, 2.0] if 4 in row else [2.0, -2.0] for row in ids]
    token = lambda ids, masks: [[[0.0, 5.0] if i == 5 else [5.0, 0.0] for i in row] for row in ids]
    models = {
        "prompt_injection": scoring.Specialist(lambda: (piece(), sequence), {0: "safe", 1: "injection"}, 6),
        "jailbreak": scoring.Specialist(lambda: (piece(), broken), {0: "safe", 1: "jailbreak"}, 6),
        "pii_ner": scoring.Specialist(lambda: (piece(), token), {0: "O", 1: "B-NAME"}, 6),
    }
    df = spark.createDataFrame([(1, "bad day"), (2, "é ann"), (3, "  "), (4, None)], "id int, text string").repartition(2)
    found = {r["id"]: r for r in scoring.specialist_results(scoring.analyzed(df, "text", models), models).collect()}
    assert all(found[i]["analysis"]["errors"] == ["jailbreak: no session"] for i in (1, 2)) and "jailbreak" not in found[1]["scores"]
    assert round(found[1]["scores"]["prompt_injection"], 3) == 0.982 and all(found[i]["scores"]["prompt_injection"] == found[i]["scores"]["contains_personal_data"] == 0.0 for i in (3, 4))
    assert found[2]["scores"]["contains_personal_data"] == 1.0 and [tuple(e) for e in found[2]["entities"]] == [("NAME", 3, 6)] and found[1]["entities"] == []
    assert spark.range(1).select(scoring.input_text(F.lit("s"), F.lit(None))).first()[0] == "[SYSTEM]\ns\n[USER]\n"
    assert spark.createDataFrame([({"a": 0.5, "b": 0.7},), ({},)], "m map<string,float>").select(scoring.max_score(F.col("m")).cast("double")).collect()[0][0] > 0.69


def test_bundle_check(spark, tmp_path):
    import hashlib

    folder = tmp_path / "bundle"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"one")
    (folder / "b.bin").write_bytes(b"two")
    listed = [("a.bin", hashlib.sha256(b"one").hexdigest(), 3), ("b.bin", "0" * 64, 3), ("c.bin", "0" * 64, 1)]
    (tmp_path / "manifest.json").write_text(json.dumps({"model": "m", "version": "1", "files": [dict(zip(("path", "sha256", "size"), x, strict=True)) for x in listed]}))
    faults = tables.bundle_faults(tables.manifest(spark, str(tmp_path / "manifest.json")), tables.bundle_files(spark, str(folder)))
    assert sorted(map(tuple, faults.collect())) == [("b.bin", "sha256"), ("c.bin", "missing")]


def test_captured(spark):
    assert [r[0] for r in spark.createDataFrame([("ab",), ("éé",)], "t string").select(responses.captured(F.col("t"), 3)).collect()] == [True, False]
    stream = 'data: {"text":"just"}\n\n'
    assert [spark.range(1).select(responses.captured_text(F.lit(stream), most)).first()[0] for most in (99, 9)] == ["just", None]
