"""Response normalisation query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalise as N
from ..sources.tables import table
from .registry import query

_RESP = """CASE event_type
 WHEN 'view' THEN IF(event_id % 7 = 0, concat('{"type": "text", "text": "single ', CAST(event_id AS STRING), '"}'),
                     concat('"text response ', CAST(event_id AS STRING), '"'))
 WHEN 'click' THEN concat('{"content": [{"type": "text", "text": "clicked ', CAST(event_id AS STRING),
   '"}, {"type": "image", "source": {"data": "iVBORw0KGgo', CAST(event_id AS STRING), '", "media_type": "image/jpeg"}}], "isError": false}')
 WHEN 'purchase' THEN concat('[{"type": "text", "text": "bought ', CAST(event_id AS STRING),
   '"}, {"type": "image", "data": "QUJD", "mimeType": "image/gif"}, {"type": "image", "source": {"data": "WFla"}}]')
 WHEN 'signup' THEN props
 ELSE CASE WHEN event_id % 4 = 0 THEN '[{"z": 1.5, "a": {"y": 1, "b": [2, null]}}, "two  words", -0.25]'
   WHEN event_id % 4 = 2 THEN '{"z": {"k": "a  b"}, "a": [ ], "content": null}' WHEN event_id % 3 = 0 THEN '[]'
   WHEN event_id % 7 = 0 THEN '""' WHEN event_id % 5 = 0 THEN '{"content": []}' ELSE 'null' END END"""

_RESP_DUCK = (_RESP.replace("IF(event_id % 7 = 0,", "CASE WHEN event_id % 7 = 0 THEN")
              .replace("'\"}'),\n", "'\"}') ELSE\n").replace("'\"'))", "'\"') END")
              .replace("CAST(event_id AS STRING)", "CAST(event_id AS VARCHAR)"))

_SCHEMA = ('[{"type":"VARCHAR","text":"VARCHAR","data":"VARCHAR","mimeType":"VARCHAR",'
           '"source":{"data":"VARCHAR","media_type":"VARCHAR"}}]')


@query("normalise_response", oracle=f"""
WITH r AS (SELECT event_id, {_RESP_DUCK} AS resp FROM events),
b AS (SELECT event_id, CASE json_type(resp)
  WHEN 'NULL' THEN NULL
  WHEN 'ARRAY' THEN CASE WHEN json_array_length(resp) = 0 THEN NULL
       WHEN json_type(resp, '$[0]') = 'OBJECT' AND list_contains(json_keys(json_extract(resp, '$[0]')), 'type')
       THEN from_json(resp, '{_SCHEMA}')
       ELSE [{{'type': 'text', 'text': CAST(json(resp) AS VARCHAR), 'data': NULL, 'mimeType': NULL, 'source': NULL}}] END
  WHEN 'OBJECT' THEN CASE WHEN json_type(resp, '$.content') = 'ARRAY' THEN from_json(json_extract(resp, '$.content'), '{_SCHEMA}')
       WHEN json_type(resp, '$.type') = 'VARCHAR' THEN [from_json(resp, '{_SCHEMA[1:-1]}')]
       ELSE [{{'type': 'text', 'text': CAST(json(resp) AS VARCHAR), 'data': NULL, 'mimeType': NULL, 'source': NULL}}] END
  WHEN 'VARCHAR' THEN CASE WHEN json_extract_string(resp, '$') <> '' THEN [{{'type': 'text', 'text': json_extract_string(resp, '$'), 'data': NULL, 'mimeType': NULL, 'source': NULL}}] END
  END AS blocks FROM r),
u AS (SELECT event_id, unnest(range(len(blocks))) AS pos, unnest(blocks) AS x FROM b WHERE blocks IS NOT NULL)
SELECT event_id, CAST(pos AS INTEGER) AS pos, x.type AS type, x.text AS text,
  CAST(length(CASE WHEN x.type = 'image' AND coalesce(x.data, '') = '' AND x.source.data IS NOT NULL THEN x.source.data ELSE x.data END) AS INTEGER) AS data_chars,
  CASE WHEN x.type = 'image' AND coalesce(x.data, '') = '' AND x.source.data IS NOT NULL
       THEN coalesce(x.source.media_type, x.mimeType, 'image/png') ELSE x.mimeType END AS mime_type
FROM u""")
def normalise_response(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_RESP).alias("resp"))
    n = N.normalise(e, "resp")
    return n.select("event_id", "pos", "type", "text", F.length("data").alias("data_chars"), "mime_type")


DUCK_EMPTY = f"""
SELECT event_id, event_type FROM (SELECT event_id, event_type, {_RESP_DUCK} AS resp FROM events)
WHERE json_type(resp) IN ('NULL', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE') OR (json_type(resp) = 'ARRAY' AND json_array_length(resp) = 0)
   OR (json_type(resp) = 'VARCHAR' AND json_extract_string(resp, '$') = '')"""


@query("empty_responses", oracle=DUCK_EMPTY)
def empty_responses(spark, sf_dir):
    """Responses that are logged as empty."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_RESP).alias("resp"))
    return N.empty_responses(e, "resp")
