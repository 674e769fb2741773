"""Accounts, sessions, grants and API outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRANT = "struct<id:string,scope_kind:string,organization_id:string,site_id:string,access_mode:string,capabilities:array<string>>"
USER = f"struct<id:string,full_name:string,email:string,username:string,category:string,access_mode:string,status:string,grants:array<{GRANT}>,created_at:string,updated_at:string>"
LOGIN = f"token string, idle_expires_at string, absolute_expires_at string, user {USER}"


def project_accounts(df: DataFrame) -> DataFrame:
    """P7."""
    return df.select("id", F.col("full_name").alias("name"), "username", "email", "token")


#: Declared fields of the payload, of its user and of a grant: none may be missing.
DECLARED = ("token", "idle_expires_at", "absolute_expires_at", *(f"user.{x}" for x in ("id", "full_name", "email", "username", "category", "access_mode", "status", "grants", "created_at", "updated_at")))
GRANT_FIELDS = ("id", "scope_kind", "organization_id", "site_id", "access_mode", "capabilities")


def _lacks(field: str):
    return lambda g: g.isNull() | g[field].isNull()


def parse_login(df: DataFrame, json_col: str, schema: str = LOGIN, required: tuple[str, ...] = DECLARED, grant_fields: tuple[str, ...] = GRANT_FIELDS) -> DataFrame:
    """P8. Unknown keys are ignored; `rejected` when any required field is missing, in the payload, its user or any grant."""
    out = df.withColumn("login", F.from_json(json_col, schema))
    missing = [F.when(F.col(f"login.{r}").isNull(), F.lit(r)) for r in required]
    missing += [F.when(F.exists("login.user.grants", _lacks(f)), F.lit(f"user.grants.{f}")) for f in grant_fields]
    return out.withColumn("missing", F.concat_ws(",", *missing)).withColumn("rejected", F.col("missing") != "")


def extract_business_error(df: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """P10. code and message for 400, 401 and 409 if both are there; malformed bodies fall through."""
    e = F.when(F.col(status).isin(400, 401, 409), F.from_json(body, "code string, message string"))
    ok = e["code"].isNotNull() & e["message"].isNotNull()
    return df.withColumn("code", F.when(ok, e["code"])).withColumn("message", F.when(ok, e["message"]))


def classify_response(df: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """P9. BUSINESS, then AUTHORIZATION (4xx), NETWORK (5xx), else SUCCESS."""
    s = F.col(status)
    return extract_business_error(df, status, body).withColumn("outcome", F.when(F.col("code").isNotNull(), "BUSINESS").when(s.between(400, 499), "AUTHORIZATION").when(s.between(500, 599), "NETWORK").otherwise("SUCCESS"))


def token_state(df: DataFrame, token_col: str = "token") -> DataFrame:
    """P11. The start screen is strict (blank is signed out), the API header lenient (only null is)."""
    t = F.col(token_col)
    state = F.when(t.isNull(), "ABSENT").when(F.trim(t) == "", "BLANK").otherwise("PRESENT")
    return df.withColumn("token_state", state).withColumn("authenticated_strict", state == "PRESENT").withColumn("authenticated_lenient", t.isNotNull())


def session_expiry(df: DataFrame, as_of: str) -> DataFrame:
    """P12. LIVE, IDLE_EXPIRED or ABSOLUTE_EXPIRED at a time; absolute wins, unreadable times are null."""
    now, idle, full = F.lit(as_of).cast("timestamp"), F.try_to_timestamp("idle_expires_at"), F.try_to_timestamp("absolute_expires_at")
    return df.withColumn("expiry", F.when(idle.isNull() | full.isNull(), None).when(full <= now, "ABSOLUTE_EXPIRED").when(idle <= now, "IDLE_EXPIRED").otherwise("LIVE"))


def _grants(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), F.explode("grants").alias("g")).select("user_id", "g.scope_kind", "g.organization_id", "g.site_id", F.explode("g.capabilities").alias("capability"))


def authorize(requests: DataFrame, users: DataFrame, sites: DataFrame) -> DataFrame:
    """J8. Flags each (user, site, capability): an organization grant covers all its sites, a site grant its own."""
    g = _grants(users)
    org = g.where("scope_kind = 'organization'").join(sites.select("organization_id", F.col("site_id").alias("covered")), "organization_id").select("user_id", F.col("covered").alias("site_id"), "capability")
    site = g.where("scope_kind = 'site'").select("user_id", "site_id", "capability")
    covered = org.unionByName(site).distinct().withColumn("ok", F.lit(True))
    return requests.join(covered, ["user_id", "site_id", "capability"], "left").withColumn("allowed", F.coalesce("ok", F.lit(False))).drop("ok")


def api_summary(df: DataFrame, top: int = 1) -> DataFrame:
    """A6. Outcomes per path, error rate and the most frequent business codes (ties by code)."""
    x = classify_response(df)
    n = x.groupBy("path").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias("n_" + o.lower()) for o in ("SUCCESS", "BUSINESS", "AUTHORIZATION", "NETWORK")])
    codes = x.where("code is not null").groupBy("path", "code").agg(F.count("*").alias("k"))
    codes = codes.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("k"), "code"))).where(F.col("r") <= top)
    codes = codes.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "code"))), lambda s: s["code"]), ",").alias("top_codes"))
    return n.join(codes, "path", "left").withColumn("error_rate", F.round(1 - F.col("n_success") / F.col("n"), 6))


def capability_census(users: DataFrame) -> DataFrame:
    """A10."""
    return _grants(users).groupBy("organization_id", "site_id", "capability").agg(F.count_distinct("user_id").alias("n_users"))
