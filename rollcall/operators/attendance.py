"""Attendance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roster(students: DataFrame, staff: DataFrame) -> DataFrame:
    """U2. One row per subject; a subject in both lists is staff."""
    u = students.select("subject_id", F.lit("student").alias("category")).unionByName(staff.select("subject_id", F.lit("staff").alias("category")))
    return u.groupBy("subject_id").agg(F.min("category").alias("category"))


def attendance_daily(checkins: DataFrame, roster_: DataFrame | None = None) -> DataFrame:
    """A9. First and last check-in and their number per subject and day; with a roster, also the category (unknown subjects null)."""
    x = checkins.groupBy("subject_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_in"), F.max("ts").alias("last_in"), F.count("*").alias("n"))
    return x.join(roster_, "subject_id", "left") if roster_ is not None else x


def attendance_by_category(daily: DataFrame) -> DataFrame:
    """A9. Present subjects by category and day."""
    return daily.where("category is not null").groupBy("category", "day").agg(F.count("*").alias("n_present"), F.sum("n").alias("n_checkins"))


def absentees(roster_: DataFrame, calendar: DataFrame, checkins: DataFrame) -> DataFrame:
    """J11. Subject and day without a check-in. The calendar's days are one array (a school has few of them), unfolded beside each subject."""
    days = calendar.agg(F.sort_array(F.collect_set("day"))).scalar()
    here = checkins.select("subject_id", F.to_date("ts").alias("day")).distinct()
    return roster_.select("subject_id", "category", days.alias("days")).select("subject_id", "category", F.explode("days").alias("day")).join(here, ["subject_id", "day"], "left_anti")


#: Days of a bin: the bits of a long.
BIN = 64


def exeat_overlap(days: DataFrame, exeats: DataFrame) -> DataFrame:
    """J12. Adds `covered`: the day lies in an approved leave [start_day, end_day] of the subject. A leave that ends before it starts covers
    nothing; one without start or end is open on that side. A null day or subject isn't covered.

    Leaves are cut at bins of 64 days, and those of a subject and bin are put together to one row, the days that they cover as bits. The
    join is on subject and bin, so it is an equality, and no day meets more than one row. Open leaves are one row a subject."""
    n = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    leave = exeats.where("subject_id is not null").select("subject_id", n("start_day").alias("a"), n("end_day").alias("z"))
    bin_of = lambda c: F.floor(c / BIN)
    cut = leave.where("a <= z").withColumn("_bin", F.explode(F.sequence(bin_of(F.col("a")), bin_of(F.col("z")))))
    first, last = F.greatest(F.col("a") - F.col("_bin") * BIN, F.lit(0)), F.least(F.col("z") - F.col("_bin") * BIN, F.lit(BIN - 1))
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (BIN - 1 - (last - first)).cast("int"))
    bits = cut.select("subject_id", "_bin", F.call_function("shiftleft", ones, first.cast("int")).alias("_bits")).groupBy("subject_id", "_bin").agg(F.bit_or("_bits").alias("_bits"))
    free = leave.where("a is null or z is null").groupBy("subject_id").agg(
        F.min(F.when(F.col("z").isNull(), F.coalesce("a", F.lit(-(2**31))))).alias("_since"), F.max(F.when(F.col("a").isNull(), F.coalesce("z", F.lit(2**31 - 1)))).alias("_until"))
    day = n("day")
    hit = F.getbit("_bits", F.pmod(day, F.lit(BIN))) == 1
    x = days.withColumn("_bin", bin_of(day)).join(bits, ["subject_id", "_bin"], "left").join(free, "subject_id", "left")
    covered = F.coalesce(hit, F.lit(False)) | F.coalesce(day >= F.col("_since"), F.lit(False)) | F.coalesce(day <= F.col("_until"), F.lit(False))
    return x.withColumn("covered", covered).select(*days.columns, "covered")


def attendance_history(checkins: DataFrame, subject: str, limit: int, offset: int = 0) -> DataFrame:
    """T2. A page of a subject's check-ins, newest first."""
    return checkins.where(F.col("subject_id") == subject).orderBy(F.desc("ts"), F.desc("seq")).offset(offset).limit(limit)
