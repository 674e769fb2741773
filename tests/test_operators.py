"""Edge cases on small tables."""

from pyspark.sql import functions as F

from rollcall.functions import codes
from rollcall.operators import accounts, attendance, captures, devices, enrollment, matching, prefs
from rollcall.sources import tables


def test_capture_contract(spark):
    df = spark.createDataFrame([(1, 400, 500, bytearray(200000)), (2, 500, 400, bytearray(200000)), (3, 400, 500, bytearray(1)), (4, 500, 400, bytearray(1)), (5, None, 500, None)], "id INT, width INT, height INT, data BINARY")
    got = {r.id: r.reason for r in captures.check_capture_shape(df).collect()}
    assert got == {1: None, 2: "BAD_DIMENSIONS", 3: "BAD_LENGTH", 4: "BAD_DIMENSIONS", 5: "BAD_DIMENSIONS"}


def test_finger_masks_round_trip(spark):
    df = spark.range(1024).select(F.col("id").cast("int").alias("m"))
    assert captures.encode_finger_mask(captures.decode_finger_mask(df, "m"), "fingers").where("m <> mask").count() == 0


def test_status(spark):
    df = spark.createDataFrame([(0,), (-6,), (302,), (-9999,), (514,), (515,), (-400,), (-503,), (-502,), (None,)], "code INT")
    got = {r.code: (r.severity, r.family) for r in captures.classify_status(df, "code").collect()}
    assert got == {0: ("OK", None), -6: ("ERROR", "general"), 302: ("WARNING", "acquisition"), -9999: ("ERROR", "general"), 514: ("WARNING", "area"), 515: ("WARNING", "area"), -400: ("ERROR", "general"), -503: ("ERROR", "general"), -502: ("ERROR", "codec"), None: (None, None)}
    names = {r.code: r.status_name for r in captures.classify_status(df, "code").collect()}
    assert (names[0], names[515], names[-6], names[-9999], names[None]) == ("STATUS_OK", "QUALITY_INVALID_AREA_HORIZONTALLY_VERTICALLY", "RESOURCE_LOCKED", "COMMAND_FAILED", None)


def test_decode_policies(spark):
    df = spark.createDataFrame([(1,), (99,), (None,)], "c INT")
    assert [r.n for r in captures.decode_codes(df, "c", codes.IMAGE_FORMAT, "default", "UNKNOWN", "n").collect()] == ["RGB24", "UNKNOWN", "UNKNOWN"]
    assert [r.n_reason for r in captures.decode_codes(df, "c", codes.PLATEN, "reject", out="n").collect()] == [None, "UNKNOWN_CODE", "UNKNOWN_CODE"]


def test_identify_without_gallery_and_ties(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0])], "probe_id LONG, vector ARRAY<DOUBLE>")
    g = spark.createDataFrame([(9, 2, [1.0, 0.0]), (4, 3, [1.0, 0.0])], "template_id LONG, subject_id INT, vector ARRAY<DOUBLE>")
    r = matching.identify(p, g.limit(0), 0.5).first()
    assert (r.outcome, r.score, r.reason) == ("RETRY", 0.0, "NO_CANDIDATE")
    assert matching.identify(p, g, 0.5).first().template_id == 4
    assert matching.candidates(p, g, 1).first().template_id == 4


def test_best_score_before_rounding(spark):
    """A better template isn't lost to a lower id within the rounding; odd vectors take no part."""
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0])], "probe_id LONG, vector ARRAY<DOUBLE>")
    g = spark.createDataFrame([(1, 1, [0.50001, 0.0]), (2, 2, [0.50003, 0.0]), (3, 3, [float("inf"), 0.0]), (4, 4, [None, 9.0]), (5, 5, []), (6, None, [0.1, 0.0])], "template_id LONG, subject_id INT, vector ARRAY<DOUBLE>")
    got = {r.probe_id: (r.template_id, r.score, r.reason) for r in matching.identify(p, g, 0.5).collect()}
    assert got == {1: (2, 0.5, None), 2: (None, 0.0, "NO_CANDIDATE"), 3: (None, 0.0, "NO_CANDIDATE"), 4: (None, 0.0, "NO_CANDIDATE")}
    assert [r.template_id for r in matching.candidates(p, g, 5).orderBy("rank").collect()] == [2, 1, 6]
    assert matching.cross_subject_duplicates(g, 0.2).collect()[0][:2] == (1, 2)


def test_gallery_by_batch(spark, tmp_path):
    def rows(*x):
        return spark.createDataFrame(list(x), "subject_id INT, finger_bit INT, batch_id INT, v STRING")

    path = str(tmp_path / "g")
    tables.upsert_gallery(rows((1, 1, 1, "a")), path, "b1")
    tables.upsert_gallery(rows((2, 1, 2, "b"), (1, 1, 2, "c")), path, "b 2/x")
    assert tables.upsert_gallery(rows((9, 9, 9, "z")), path, "b1").count() == 2  # the batch is there already
    got = tables.upsert_gallery(rows((3, 1, 3, "d")), path, "b3").collect()
    assert sorted((r.subject_id, r.v) for r in got) == [(1, "c"), (2, "b"), (3, "d")]
    for _ in range(2):
        tables.write_rejects(spark.createDataFrame([(1, "X")], "id INT, reason STRING"), str(tmp_path / "r"), "a b")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_listed_property(spark):
    df = spark.createDataFrame([("50 100 150 200 250",), (" 10 10  10 10 1000",), ("9 100 150 200 250",), ("50 100",), ("50 x 1 2 3",), (None,)], "value STRING").withColumn("property", F.lit("WET_FINGER_DETECT_LEVEL_THRESHOLD"))
    assert [r.verdict for r in devices.audit_properties(df).collect()] == ["OK", "OK", "OUT_OF_RANGE", "OUT_OF_RANGE", "NOT_NUMERIC", "NOT_NUMERIC"]


def test_slots_and_outcomes(spark):
    ops = spark.createDataFrame([(1, 1, 1, "add", False), (1, 1, 2, "add", False), (1, 1, 3, "add", True), (1, 1, 4, "remove", False), (1, 2, 5, "add", False)], "session_id INT, finger_bit INT, seq INT, op STRING, force BOOLEAN")
    results, masks = enrollment.finger_slots(ops)
    assert [r.result for r in results.orderBy("seq").collect()] == ["OK", "ALREADY_USED", "OK", "OK", "OK"]
    assert masks.first().mask == 2


def test_responses_and_tokens(spark):
    df = spark.createDataFrame([(400, '{"code":"a","message":"b"}'), (400, "x"), (403, '{"code":"a","message":"b"}'), (503, None), (302, None)], "status INT, body STRING")
    assert [r.outcome for r in accounts.classify_response(df).collect()] == ["BUSINESS", "AUTHORIZATION", "AUTHORIZATION", "NETWORK", "SUCCESS"]
    t = spark.createDataFrame([(None,), (" ",), ("t",)], "token STRING")
    assert [(r.token_state, r.authenticated_lenient) for r in accounts.token_state(t).collect()] == [("ABSENT", False), ("BLANK", True), ("PRESENT", True)]


def test_typed_preferences(spark):
    df = spark.createDataFrame([("int", "1"), ("int", "x"), ("boolean", "true"), ("json", '{"k":1}')], "type_tag STRING, value STRING")
    assert [(r.decoded, r.reason) for r in prefs.decode_kv(df, "k INT").collect()] == [("1", None), (None, "BAD_VALUE"), ("true", None), ('{"k":1}', None)]


def test_no_devices(spark):
    d = spark.createDataFrame([(1, 5)], "device_id LONG, vendor_id INT")
    assert [r.error for r in devices.blocked_devices(d, d).collect()] == ["DEVICE_NOT_FOUND"]


def test_roster_once(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "subject_id STRING"), spark.createDataFrame([("y",)], "subject_id STRING")
    assert {r.subject_id: r.category for r in attendance.roster(a, b).collect()} == {"x": "student", "y": "staff"}


def test_duplicates_by_level(spark):
    """The session's level gives the threshold; without level or threshold nothing is a duplicate."""
    prints = spark.createDataFrame([(s, i, 1 << i, [1.0, 0.1 * i]) for s in (1, 2, 3, 4) for i in range(3)], "session_id INT, print_id INT, finger_bit INT, vector ARRAY<DOUBLE>")
    levels = spark.createDataFrame([(1, 7), (2, 5), (3, 9)], "session_id INT, security_level INT")
    least = spark.createDataFrame([(7, 1.01), (5, 5.0)], "security_level INT, threshold DOUBLE")
    got = {(r.session_id, r.print_id): r.matched_mask for r in matching.duplicate_fingers(prints, least, levels).collect()}
    assert got == {(s, i): 2 if (s, i) == (1, 2) else 0 for s in (1, 2, 3, 4) for i in range(3)}
    assert {r.matched_mask for r in matching.duplicate_fingers(prints, 0.5).where("session_id = 4").collect()} == {0, 1, 3}
