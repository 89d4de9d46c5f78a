"""The corpus operators' queries, and oracle SQL where SQL can express them."""

from __future__ import annotations

from rookery.llm.decontamination import op3_decontamination
from rookery.llm.fingerprints import op2_fingerprints
from rookery.llm.html import op8_html
from rookery.llm.licenses import op7_licenses
from rookery.llm.lm import op5_lm
from rookery.llm import mixing, spelling
from rookery.llm.mixing import op12_mixing
from rookery.llm.packing import op9_packing
from rookery.llm.quality import op4_quality
from rookery.llm.secrets import op10_secrets
from rookery.llm.simhash import op1_simhash
from rookery.llm.spelling import op13_spelling
from rookery.llm.warc import op6_warc
from rookery.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_simhash, op2_fingerprints, op3_decontamination, op4_quality, op5_lm, op6_warc, op7_licenses, op8_html, op9_packing, op10_secrets, op11_whitening, op12_mixing, op13_spelling)}

#: SHA-1 in base 32 from its hex digits: five of them are 20 bits and four characters.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(hx, cast(5 * (k // 4) + 1 as bigint), 5) as bigint) >> (15 - 5 * (k % 4))) & 31 as bigint) + 1, 1)), '')"

ORACLES: dict[str, str] = {
    "op6_warc": f"""with h as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hx from pages), f as (select hx, min(page_id) as first from h group by 1)
      select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from h join f using (hx)""",
    "op12_mixing": mixing.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
