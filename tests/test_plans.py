"""Plan documents of both versions: steps, findings and checksum."""

from __future__ import annotations

import json

import pytest

from tickloom.plans import compiled as P

# A valid document of version 1 and the checksum it was published with.
FIRST = {
    "contractVersion": "strategy-bot.v1",
    "schemaVersion": "basic-compiled-plan.v1",
    "elementCatalogVersion": "basic-elements:2026-07-31",
    "instrumentCatalogVersion": "us-supported-universe:2026-07-31",
    "compilerVersion": "basic-compiler:1.0.0",
    "requiredFeatureSetHash": "sha256:" + "3" * 64,
    "requiredFeatures": [
        {
            "requirementId": "rsi-14-pt1m", "featureId": "00000000-0000-4000-8000-000000000401", "featureVersion": "1.0.0",
            "instruments": ["00000000-0000-4000-8000-000000000301"], "resolution": "PT1M", "requiredObservations": 14,
        }
    ],
    "executionSnapshot": {
        "immutableStrategyVersion": {"snapshotSchemaVersion": "basic-launch-snapshot.v1", "semanticHash": "sha256:" + "2" * 64, "snapshotHash": "sha256:" + "1" * 64},
        "mode": "BASIC", "initialCashAmount": "100000.00000000", "currency": "USD",
        "partitions": [{"key": "partition-1", "budgetCapBps": 10000, "flows": [{"key": "flow-1", "officialInstrumentIds": ["00000000-0000-4000-8000-000000000301"]}]}],
    },
    "steps": [
        {"sequence": 1, "operation": "LOAD_FEATURE", "arguments": {"feature": "RSI_14", "resolution": "1m"}},
        {"sequence": 2, "operation": "COMPARE", "arguments": {"operator": "LT", "threshold": "30"}},
        {"sequence": 3, "operation": "EMIT_ORDER_CANDIDATE", "arguments": {"allocation": "EQUAL", "orderType": "MARKET", "side": "BUY"}},
    ],
}
CHECKSUM = "sha256:88d61198d46dce161c2a929702a7fd1cee5c9b044c470d2590b96f3825fcacb3"


@pytest.fixture(scope="module")
def plans(spark):
    second = json.loads(json.dumps(FIRST))
    steps = second.pop("steps")
    second["elementCatalogVersion"] = "basic-elements:2026-08-25"
    steps = [
        {"sequence": 1, "operation": "RSI_CROSS", "arguments": {"resolution": "1d", "direction": "UP", "period": "14", "threshold": "30"}},
        {"sequence": 2, "operation": "STREAK", "arguments": {"resolution": "1d", "direction": "UP", "bars": "4"}},
        {
            "sequence": 3, "operation": "EMIT_ORDER_CANDIDATE",
            "arguments": {"allocation": "EQUAL", "orderType": "MARKET", "timeInForce": "DAY", "side": "BUY", "orderPercent": "0", "maxPositionPercent": "100", "executionMode": "1회만", "waitMode": "N봉 이후", "waitInterval": "1", "maxExecutions": "2"},
        },
    ]
    second["executionSnapshot"]["partitions"][0]["flows"][0]["steps"] = steps
    rows = [("first", json.dumps(FIRST)), ("second", json.dumps(second, ensure_ascii=False)), ("broken", "{"), ("null", None)]
    return spark.createDataFrame(rows, "plan_id string, plan_json string")


def test_both_versions_keep_their_steps(plans):
    found = [(r["plan_id"], r["flow_id"], r["sequence"], r["operation"]) for r in P.flatten(plans).collect()]
    assert [f for f in found if f[0] == "first"] == [("first", "flow-1", 1, "LOAD_FEATURE"), ("first", "flow-1", 2, "COMPARE"), ("first", "flow-1", 3, "EMIT_ORDER_CANDIDATE")]
    assert len([f for f in found if f[0] == "second"]) == 3
    assert {f[0] for f in found} == {"first", "second", "broken", "null"}


def test_valid_plan_has_no_findings_and_limits_are_the_contracts(spark, plans):
    found = {(r["plan_id"], r["sequence"], r["argument"], r["finding"]) for r in P.lint(P.flatten(plans), P.specs(spark)).collect()}
    assert not [f for f in found if f[0] == "first"]
    assert {f for f in found if f[0] == "second"} == {("second", 2, "bars", "NOT_ALLOWED"), ("second", 3, "orderPercent", "OUT_OF_BOUNDS")}
    assert {f[3] for f in found if f[0] == "broken"} == {"UNSUPPORTED_CATALOGUE", "NO_STEPS"}


def test_catalogue_has_every_operation_of_every_version(spark):
    by_version = {r["catalogue_version"]: r["n"] for r in P.specs(spark).groupBy("catalogue_version").agg({"operation": "count"}).toDF("catalogue_version", "n").collect()}
    assert set(by_version) == set(P.VERSIONS) and by_version[P.VERSIONS[-1]] == by_version[P.VERSIONS[1]] + 1
    assert P.specs(spark).select("operation").distinct().count() == 16


def test_checksum_is_the_published_one(plans):
    found = {r["plan_id"]: r["checksum"] for r in P.plan_checksum(plans).collect()}
    assert found["first"] == CHECKSUM and found["broken"] is None and found["null"] is None and found["second"] not in (None, CHECKSUM)
