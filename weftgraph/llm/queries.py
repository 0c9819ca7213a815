"""Queries of this subpackage, by the names under which they are registered, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, langid, licenses, lm, media, packing, pii, simhash, tokens, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_language_id": langid.op3_language_id,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_lm_score": lm.op5_lm_score,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_media_columns": media.op7_media_columns,
    "op8_warc": warc.op8_warc,
    "op9_pii": pii.op9_pii,
    "op10_packing": packing.op10_packing,
}

# Base 32 of a digest of 40 hex digits: each five of them make four characters.
BASE32 = "array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x'||substr(d, cast((j//4)*5+1 as int), 5))::bigint >> (15-5*(j%4))) & 31) as int)+1, 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op8_warc": f"""with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d from pages), m as (select d, min(page_id) f from p group by d)
        select page_id, cast(strlen(h) as bigint) payload_bytes, {BASE32} payload_digest, case when page_id = f then 'response' else 'revisit' end record_type,
        case when page_id <> f then f end refers_to from p join m using (d)""",
}
