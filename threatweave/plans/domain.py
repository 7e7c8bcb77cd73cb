"""The domain's tables, derived from the given ones.

Each table is one SELECT that Spark and an oracle database both understand; ``{name}`` stands for a given table,
``{days:x}``, ``{hours:x}`` and ``{list:a|b}`` for what the two write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TABLES = {
    # A threat report from every document: its text with the sentence that the domain's extractors look for.
    "reports": """
        SELECT doc_id, source AS publisher, lang,
          substring(replace(text, chr(10), ' '), 1, 60) AS title,
          concat('https://www.', source, '.example.org/post/', cast(doc_id % 700 AS STRING), '/?utm_source=x&p=', cast(doc_id % 5 AS STRING)) AS url,
          cast('2024-01-01 00:00:00' AS TIMESTAMP) + {hours:doc_id % 960} AS published,
          CASE WHEN doc_id % 7 = 0 THEN 'A' WHEN doc_id % 3 = 0 THEN 'C' ELSE 'B' END AS reliability,
          concat(text, ' Actor APT', cast(doc_id % 40 + 1 AS STRING), ' exploited CVE-2024-', lpad(cast(1000 + doc_id % 211 AS STRING), 5, '0'),
            ' in the public web server of Retail firms. The C2 was hxxps://cdn', cast(doc_id % 97 AS STRING), '[.]update', cast(doc_id % 13 AS STRING), '[.]top/a?id=', cast(doc_id % 3 AS STRING),
            ' and 45.', cast(doc_id % 200 AS STRING), '.', cast(doc_id % 17 AS STRING), '[.]9 with hash ', md5(cast(doc_id % 300 AS STRING)),
            '. Ransomware was dropped by powershell and files were encrypted. Patch the server immediately and rotate all keys.') AS text
        FROM {documents}""",
    # Research from every order.
    "research": """
        SELECT concat('TR-', substring(cast(o_orderdate AS STRING), 1, 4), '-', lpad(cast(o_orderkey AS STRING), 6, '0')) AS research_id, o_orderkey AS rid,
          CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'P' THEN 'running' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'archived' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'draft' END END AS status,
          CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
          concat('Campaign ', cast(o_custkey AS STRING), ' of ', o_orderpriority) AS title,
          cast(o_orderdate AS TIMESTAMP) AS created_at, cast(o_orderdate AS TIMESTAMP) + {hours:o_orderkey % 400} AS updated_at,
          CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS TIMESTAMP) + {hours:o_orderkey % 97 + 1} END AS published_at,
          concat('user', cast(o_custkey % 23 AS STRING)) AS created_by,
          {list:concat('ws', cast(o_custkey % 25 AS STRING))|concat('ws', cast(o_orderkey % 25 AS STRING))} AS workspace_ids,
          o_orderkey % 12 AS n_iocs, o_orderkey % 7 AS n_queries,
          lower(concat('campaign ', cast(o_custkey AS STRING), ' cve-2024-', cast(1000 + o_orderkey % 211 AS STRING), ' actor', cast(o_custkey % 40 AS STRING), ' ', o_orderpriority)) AS search_text,
          o_totalprice AS price
        FROM {orders}""",
    # A mention from every line item: which technique, actor, malware and source a research names.
    "mentions": """
        SELECT l_orderkey AS rid, l_linenumber AS pos, concat('S', cast(l_suppkey % 12 + 1 AS STRING)) AS source_id,
          concat('actor', cast(l_suppkey % 40 AS STRING)) AS actor, concat('mal', cast(l_partkey % 90 AS STRING)) AS malware,
          concat('T', cast(1000 + l_partkey % 60 AS STRING)) AS technique_id, concat('TA', cast(l_partkey % 60 % 14 AS STRING)) AS tactic_id,
          concat('CVE-2024-', cast(1000 + l_partkey % 150 AS STRING)) AS cve,
          CASE l_linenumber % 3 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'domain' ELSE 'sha256' END AS ioc_type,
          CASE l_linenumber % 3 WHEN 0 THEN concat('45.', cast(l_partkey % 200 AS STRING), '.', cast(l_suppkey % 50 AS STRING), '.7') WHEN 1 THEN concat('Cdn', cast(l_partkey % 97 AS STRING), '.update', cast(l_suppkey % 13 AS STRING), '.top')
            ELSE concat(md5(cast(l_partkey % 100 AS STRING)), md5('x')) END AS ioc_value,
          concat('The actor actor', cast(l_suppkey % 40 AS STRING), ' used mal', cast(l_partkey % 90 AS STRING), ' on day ', cast(l_linenumber AS STRING)) AS quote,
          l_returnflag AS flag, l_linestatus AS state, cast(l_shipdate AS TIMESTAMP) AS seen_at, l_quantity AS quantity, l_discount AS discount, l_partkey AS partkey, l_suppkey AS suppkey
        FROM {lineitem}""",
    "links": """
        SELECT rid, 'actor' AS entity_type, actor AS entity_key FROM mentions UNION ALL SELECT rid, 'malware', malware FROM mentions UNION ALL SELECT rid, 'cve', cve FROM mentions""",
    "results": """
        SELECT rid, concat('ws', cast(suppkey % 25 AS STRING)) AS workspace_id,
          CASE flag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'suspicious' ELSE CASE WHEN state = 'O' THEN 'pending' ELSE 'no_evidence' END END AS status, max(seen_at) AS updated_at
        FROM mentions GROUP BY 1, 2, 3""",
    "sources": """
        SELECT DISTINCT rid, source_id, concat('Publisher ', substring(source_id, 2, 5)) AS publisher FROM mentions""",
    "workspaces": """
        SELECT concat('ws', cast(n_nationkey AS STRING)) AS workspace_id, n_name AS name, n_regionkey AS region FROM {nation}""",
    "users": """
        SELECT concat('user', cast(c_custkey AS STRING)) AS user_id, c_name AS name, c_mktsegment AS team FROM {customer}""",
    "actors": """
        SELECT concat('actor', cast(s_suppkey AS STRING)) AS actor_id, s_name AS name, {list:concat('Alias', cast(s_suppkey % 30 AS STRING))|concat('Group', cast(s_suppkey AS STRING))} AS aliases, s_nationkey AS nation FROM {supplier}""",
    "products": """
        SELECT concat('ws', cast(p_partkey % 25 AS STRING)) AS workspace_id, p_partkey AS pos, p_name AS product FROM {part}""",
    # Stored queries from every part: twelve a research, some in groups, some with a sigma rule.
    "queries": """
        SELECT p_partkey AS qid, concat('Q-', cast(p_partkey AS STRING)) AS query_id, cast(floor(p_partkey / 12) AS BIGINT) AS rid, CASE WHEN p_partkey % 5 < 3 THEN concat('G', cast(p_size % 4 AS STRING)) END AS group_id,
          CASE WHEN p_partkey % 5 = 3 THEN concat('Q-', cast(p_partkey - p_partkey % 4 AS STRING)) END AS sigma_ref, CASE p_partkey % 4 WHEN 0 THEN 'sigma' WHEN 1 THEN 'kql_sentinel' WHEN 2 THEN 'splunk' ELSE 'KQL Custom' END AS platform,
          CASE p_size % 3 WHEN 0 THEN 'ioc' WHEN 1 THEN 'ttp' ELSE 'ioa' END AS type, CASE p_size % 4 WHEN 0 THEN 'generated' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'deployed' ELSE 'deprecated' END AS status,
          concat('T', cast(1000 + p_partkey % 60 AS STRING)) AS technique_id, concat('T', cast(1000 + p_size AS STRING)) AS second_id, CASE WHEN p_partkey % 7 = 0 THEN 'reference' ELSE 'generated' END AS origin,
          p_name AS title, concat(p_type, '  where ', p_brand, ' ', cast(p_size % 3 AS STRING)) AS body, p_retailprice AS price
        FROM {part}""",
    # Telemetry from every event.
    "telemetry": """
        SELECT event_id, cast(ts AS TIMESTAMP) AS ts, concat('host', cast(user_id % 40 AS STRING)) AS host, concat('ws', cast(user_id % 25 AS STRING)) AS workspace_id,
          CASE event_type WHEN 'click' THEN 'web' WHEN 'view' THEN 'network' WHEN 'error' THEN 'process_creation' WHEN 'signup' THEN 'dns' ELSE 'file_hash' END AS category,
          CASE event_type WHEN 'error' THEN concat('C:\\Windows\\System32\\', CASE event_id % 4 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'powershell.exe' WHEN 2 THEN 'w3wp.exe' ELSE 'notepad.exe' END) END AS image,
          CASE event_type WHEN 'error' THEN concat('run -', CASE event_id % 3 WHEN 0 THEN 'Enc' ELSE 'x' END, ' ', props) END AS command_line,
          CASE event_type WHEN 'click' THEN concat('/layouts/', cast(user_id % 9 AS STRING), '/start.aspx') END AS url_path,
          CASE event_type WHEN 'view' THEN concat('45.', cast(event_id % 200 AS STRING), '.', cast(user_id % 50 AS STRING), '.7') END AS dst_ip,
          CASE event_type WHEN 'signup' THEN concat('CDN', cast(event_id % 97 AS STRING), '.update', cast(user_id % 13 AS STRING), '.top') END AS domain,
          CASE event_type WHEN 'purchase' THEN concat(md5(cast(event_id % 100 AS STRING)), md5('x')) END AS sha256,
          value, user_id
        FROM {events}""",
    # An access log from every event.
    "access": """
        SELECT event_id, cast(ts AS TIMESTAMP) AS seen_at, concat('user', cast(user_id AS STRING)) AS user_id, CASE WHEN event_id % 10 = 0 THEN 'POST' ELSE 'GET' END AS method,
          CASE event_type WHEN 'click' THEN concat('/api/research/TR-', cast(event_id % 20 AS STRING)) WHEN 'view' THEN concat('/api/library/cves/cve-2024-', cast(1000 + event_id % 9 AS STRING), '/')
            WHEN 'error' THEN '/api/research/check-duplicates' WHEN 'signup' THEN concat('/api/library/actors/a%20', cast(event_id % 5 AS STRING)) ELSE concat('/api/research/x/', cast(event_id AS STRING)) END AS path
        FROM {events}""",
    # Comment threads from every conversation.
    "comments": """
        SELECT conv_id * 1000 + turn AS comment_id, conv_id AS thread_id, turn AS pos, concat('user', cast((conv_id + turn * (conv_id % 3)) % 50 + 1 AS STRING)) AS author,
          CASE conv_id % 4 WHEN 0 THEN 'iocs' WHEN 1 THEN 'mitre' WHEN 2 THEN 'hunts' ELSE 'report' END AS section, conv_id % 3 = 0 AS resolved,
          concat(substring(replace(text, chr(10), ' '), 1, 40), ' @user', cast(conv_id % 60 + 1 AS STRING), ' see @Customer#', cast(turn AS STRING)) AS text
        FROM {conversations}""",
}
NEEDS = {name: re.findall(r"\bFROM ([a-z]+)\b", sql) for name, sql in TABLES.items()}


def _written(sql: str, spark: bool, given) -> str:
    def special(m: re.Match) -> str:
        kind, x = m[1], m[2]
        if kind == "list":
            return f"array({x.replace('|', ', ')})" if spark else f"[{x.replace('|', ', ')}]"
        number = {"days": 0, "hours": 1}[kind]
        if spark:
            return f"make_dt_interval({', '.join('0' if k != number else f'cast({x} AS INT)' for k in range(2))})"
        return f"to_{kind}(cast({x} AS INT))"

    sql = re.sub(r"\{(list|days|hours):([^{}]*)\}", special, sql)
    sql = re.sub(r"\{(\w+)\}", lambda m: given(m[1]), sql)
    if spark:
        sql = re.sub(r"'((?:[^'])*)'", lambda m: "r'" + m[1] + "'" if "\\" in m[1] else m[0], sql)
        return sql.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    return sql


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in NEEDS[n]:
            if m in TABLES:
                out += [x for x in _order([m]) if x not in out]
        if n not in out:
            out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or given table."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
    order = _order([name])
    parts = [f"{n} AS ({_written(TABLES[n], True, given)})" for n in order]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def oracle(sql: str) -> str:
    """``sql`` over derived tables, with what it needs in front."""
    names = [n for n in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    parts = [f"{n} AS ({_written(TABLES[n], False, lambda t: t)})" for n in _order(names)]
    body = sql.strip()
    if not parts:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {', '.join(parts)}, {re.sub(r'(?i)^with\s+recursive\s+', '', body)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {', '.join(parts)}, {re.sub(r'(?i)^with\s+', '', body)}"
    return f"WITH {', '.join(parts)} {body}"
