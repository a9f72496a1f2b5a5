"""Declared shapes of the built tables and a strict check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POLICY = "struct<audience:string,form:string,value:double,count:int,age_range:struct<min:int,max:int>,source_phrase:string>"
COUPON = f"struct<capacity:struct<kind:string,n:int>,audience_policies:array<{POLICY}>,summary:string,source_phrase_block:string>"
RESTRICTIONS = ("struct<blackout:array<struct<month:int,day:int>>,blackout_recurring:array<string>,weekdays_only:boolean,seasonal:string,"
                "advance_booking_required:boolean,booking_frequency_limit:string,late_return_penalty:string>")
PASS = (f"platform string, library_id string, attraction_slug string, attraction_rawslug string, pass_form string, all_branches boolean, source_url string, "
        f"coupon {COUPON}, restrictions {RESTRICTIONS}, residency_restriction struct<restricted:string,scope:string,source:string,evidence:string>, "
        "requires_own_card boolean, own_card_evidence string, booking_access_probe struct<verdict:string,source:string,evidence:string,prober_card:string,probed_date:string>, "
        "availability map<string,string>, eligibility_override string")
BRANCH = "branch_id string, library_id string, name string, town string, lat double, lon double"
OVERRIDE = "kind string, id string, field string, status string, value string, source string, evidence string, note string"
EVIDENCE = "entity_kind string, entity_id string, field string, audience string, phrase string, block string, url string, confidence string"
RAW_PAGE = "entity_kind string, entity_id string, page_name string, source_url string, html string, fetched_at timestamp"


def differences(df: DataFrame, ddl: str) -> list[str]:
    """Missing, unknown and differently typed columns (nullability is not part of the shape)."""
    want = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(ddl).fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ([f"missing {n}" for n in want if n not in have] + [f"unknown {n}" for n in have if n not in want]
            + [f"{n}: {have[n]} instead of {want[n]}" for n in want if n in have and have[n] != want[n]])


def schema_lock(df: DataFrame, ddl: str) -> DataFrame:
    """The frame in declared column order; raises when its shape differs."""
    wrong = differences(df, ddl)
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*[f.name for f in T.StructType.fromDDL(ddl).fields])
