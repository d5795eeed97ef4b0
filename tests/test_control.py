import pytest

from logweir.functions.hashing import bootstrap_id
from logweir.operators import control, policy


def _log(spark, commands):
    return control.records(spark, commands, 0, "2024-01-01 00:00:00", "ann")


def _move(kind, mid, source=None, target=None, shard=5):
    fields = {"MigrationId": mid, "StreamName": "orders", "VirtualShardIndex": str(shard)}
    return kind, fields | ({"FromGroupId": source} if source else {}) | ({"ToGroupId": target} if target else {})


START, CUT, ABORT = ("MigrationStarted", "a", "g1", "g2"), ("Cutover", "a", None, "g2"), ("MigrationAborted", "a")


@pytest.mark.parametrize("steps,want", [
    ([START], ("g1", "g2", "a")),
    ([START, CUT], ("g2", None, "a")),
    ([START, CUT, START], ("g2", None, "a")),
    ([START, ABORT], ("g1", None, None)),
    ([START, ("MigrationStarted", "b", "g1", "g3")], ("g1", "g2", "a")),
    ([START, ("Cutover", "b", None, "g3")], ("g1", "g2", "a")),
    ([START, CUT, ABORT, START], ("g1", "g2", "a")),
    ([START, CUT, ("MigrationStarted", "b", "g2", "g3")], ("g2", "g3", "b")),
    ([START, CUT, ("MigrationCompleted", "a")], ("g2", None, "a")),
])
def test_assignment_fold(spark, steps, want):
    r = control.assignments(_log(spark, [_move(*s) for s in steps])).collect()
    assert [(x.group_id, x.migrating_to, x.migration_id) for x in r] == [want]


def test_unknown_shard_is_ignored(spark):
    assert control.assignments(_log(spark, [_move(*CUT), _move(*ABORT)])).count() == 0


def test_create_stream_places_every_shard(spark):
    commands = control.create_stream("orders", 3, {0: "g1", 1: "g2", 2: "g1"})
    log = _log(spark, commands)
    got = {r.vshard: (r.group_id, r.migration_id) for r in control.assignments(log).collect()}
    assert got == {i: (g, bootstrap_id("orders", i)) for i, g in enumerate(("g1", "g2", "g1"))}
    assert control.streams(log).first().vshards == 3
    again = log.unionByName(control.records(spark, commands, 100, "2024-01-01 00:00:00"))
    assert {r.vshard: (r.group_id, r.migration_id) for r in control.assignments(again).collect()} == got
    with pytest.raises(ValueError):
        control.create_stream("orders", 2, {0: "g1"})
    kind, fields = control.reshard_commands("start", "m", "orders", 1, "g1", "g2")
    assert kind == "MigrationStarted" and fields["ToGroupId"] == "g2"


def test_policies_and_access(spark):
    s = {"StreamName": "orders", "ConsumerGroup": "c"}
    log = _log(spark, [
        ("SetConsumerGroupAckMode", s | {"Mode": "Checkpoint"}), ("SetConsumerGroupMandatory", s | {"Mandatory": "false"}), ("SetConsumerGroupAckMode", s | {"Mode": "Strict"}),
        ("SetStreamRetentionPolicy", {"StreamName": "orders", "AuditRetention": "-1", "MaxRetention": "9", "MaxSizeBytesPerVirtualShard": "-2"}),
        ("SetStreamCheckpointInterval", {"StreamName": "orders", "Interval": "7", "OffsetCount": "3"}), ("SetStreamCheckpointInterval", {"StreamName": "orders", "Interval": None, "OffsetCount": "4"}),
        ("SetProduceAcl", {"Subject": "u", "StreamName": "orders", "Allowed": "true"}), ("SetProduceAcl", {"Subject": "u", "StreamName": "orders", "Allowed": "false"}),
        ("SetConsumeAcl", s | {"Subject": "u", "Allowed": "true"}), ("SetStreamSubjectClaimType", {"StreamName": "orders", "ClaimType": "email"}),
        ("RegisterGroup", {"GroupId": "g1", "Members": "n1@http://a:1, n2@http://b:2"}),
    ])
    p = control.group_policies(log).first()
    assert (p["mode"], p.mandatory) == ("Strict", False)
    r = control.retention_policies(log).first()
    assert (r.audit_us, r.max_us, r.max_bytes, r.checkpoint_us, r.checkpoint_count) == (0, 9, None, None, 4)
    ask = spark.createDataFrame([("u", "orders", "c", {"sub": "x", "email": "e"}), ("v", "orders", "c", {"sub": "y"})], "subject string, stream string, consumer_group string, claims map<string,string>")
    assert [x.allowed for x in policy.can_produce(ask, control.produce_acl(log)).collect()] == [False, False]
    assert {x.subject: x.allowed for x in policy.can_consume(ask, control.consume_acl(log)).collect()} == {"u": True, "v": False}
    who = policy.subject(ask.withColumnRenamed("subject", "asked"), control.claim_overrides(log), "sub")
    assert {x.asked: x.subject for x in who.collect()} == {"u": "e", "v": None}
    cleared = log.unionByName(control.records(spark, [("SetStreamSubjectClaimType", {"StreamName": "orders", "ClaimType": None})], 50, "2024-01-01 00:00:00"))
    assert control.claim_overrides(cleared).first().claim_type is None
    addresses = spark.createDataFrame([("n2", "b")], "node_id string, address string")
    assert policy.redirects(control.groups(log), addresses).first().node_id == "n2"
    assert control.describe(log).where("version = 5").first().fields["Interval"] == ""
    assert control.last_version(log).first()[0] == 10 and control.newer(log, 8).count() == 2


def test_commands_are_validated(spark):
    assert [k for k, _ in control.set_group_flag("s", "g", "Strict", False)] == ["SetConsumerGroupAckMode", "SetConsumerGroupMandatory"]
    assert control.set_stream_policy("s", (1, 2), None, (None, 3))[1][1]["OffsetCount"] == "3"
    assert control.manage_acl("u", "s", True)[0] == "SetProduceAcl" and control.manage_acl("u", "s", True, "g")[0] == "SetConsumeAcl"
    for bad in (lambda: control.set_group_flag("s", "g", "Odd"), lambda: control.manage_acl("", "s", True), lambda: control.set_claim_type("", None)):
        with pytest.raises(ValueError):
            bad()
    log = _log(spark, [control.register_group("g", {"n1": "http://a:1"}), control.set_claim_type("s", "sub"), *control.set_stream_policy("s", (5, 6), 7)])
    assert control.groups(log).first().members[0].address == "http://a:1" and control.claim_overrides(log).first().claim_type == "sub"
    assert control.retention_policies(log).first().max_bytes == 7
