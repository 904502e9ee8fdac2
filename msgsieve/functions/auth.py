"""Sender-authentication columns from the receiver's header stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgsieve.functions.text import text_or_empty
from msgsieve.functions.urls import registrable

RESULTS = "pass|fail|softfail|neutral|none|temperror|permerror"


def last_verdict(stamps: Column, mechanism: str) -> Column:
    """The last stamp of a mechanism wins; empty if there is none."""
    found = F.regexp_extract_all(stamps, F.lit(rf"{mechanism}\s*=\s*({RESULTS})"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))


def address_domain(address: Column) -> Column:
    return registrable(F.regexp_extract(text_or_empty(address), r"@([A-Za-z0-9.\-]{1,253})", 1))


def loose_address_domain(address: Column) -> Column:
    """Like ``address_domain`` but also takes a bare host."""
    a = text_or_empty(address)
    at = F.regexp_extract(a, r"@([A-Za-z0-9.\-]+)", 1)
    bare = F.regexp_extract(a, r"([A-Za-z0-9\-]+\.[A-Za-z0-9.\-]+)", 1)
    return registrable(F.when(at != "", at).otherwise(bare))


def with_auth_columns(df: DataFrame, sender: str = "sender", results: str = "auth_results",
                      received_spf: str = "received_spf", dkim_signature: str = "dkim_signature",
                      return_path: str = "return_path", bare_hosts: bool = True) -> DataFrame:
    """Add the eleven auth flags (0/1).

    ``bare_hosts`` lets From and Return-Path values without ``@`` count, as the
    classifier features do; the allow-list check passes False.
    """
    domain_of = loose_address_domain if bare_hosts else address_domain
    ar = F.lower(text_or_empty(F.col(results)))
    spf_header = F.substring(F.lower(text_or_empty(F.col(received_spf))), 1, 16)
    signature = text_or_empty(F.col(dkim_signature))
    stamped = F.regexp_extract(ar, r"header\.d=([A-Za-z0-9.\-]+)", 1)
    signed = F.when(stamped != "", stamped).otherwise(F.regexp_extract(signature, r"d=([A-Za-z0-9.\-]+)", 1))
    spf = last_verdict(ar, "spf")
    spf = F.when(spf != "", spf).when(spf_header.contains("pass"), "pass").when(spf_header.contains("fail"), "fail").otherwise("")
    staged = df.select(
        "*", spf.alias("_spf"), last_verdict(ar, "dkim").alias("_dkim"), last_verdict(ar, "dmarc").alias("_dmarc"),
        registrable(signed).alias("_signed"), domain_of(F.col(sender)).alias("_from"),
        domain_of(F.col(return_path)).alias("_path"),
        ((ar != "") | (spf_header != "") | (signature != "")).alias("_present"))
    c = F.col
    aligned = (c("_signed") != "") & (c("_signed") == c("_from"))
    mismatch = (c("_path") != "") & (c("_from") != "") & (c("_path") != c("_from"))
    dmarc_pass = c("_dmarc") == "pass"
    spf_fail = c("_spf").isin("fail", "softfail")
    flags = {
        "auth_present": c("_present"), "spf_pass": c("_spf") == "pass", "dkim_pass": c("_dkim") == "pass",
        "dmarc_pass": dmarc_pass, "spf_fail": spf_fail, "dkim_fail": c("_dkim") == "fail",
        "dmarc_fail": c("_dmarc") == "fail", "dkim_aligned": aligned, "rp_mismatch": mismatch,
        "auth_pass": dmarc_pass | ((c("_spf") == "pass") & aligned),
        "auth_fail": (c("_dmarc") == "fail") | spf_fail | (c("_dkim") == "fail")
        | (c("_present") & mismatch & ~dmarc_pass),
    }
    return (staged.withColumns({k: v.cast("int") for k, v in flags.items()})
            .drop("_spf", "_dkim", "_dmarc", "_signed", "_from", "_path", "_present"))


AUTH_FLAGS = ["auth_present", "spf_pass", "dkim_pass", "dmarc_pass", "spf_fail", "dkim_fail", "dmarc_fail",
              "dkim_aligned", "rp_mismatch", "auth_pass", "auth_fail"]
