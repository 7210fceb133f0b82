"""A corpus with one planted token of every rule, made by the same SQL text in Spark and in other engines.

Prefixes of tokens are split so that no literal looks like a credential.
"""

from __future__ import annotations

VARIABLES = """
  SELECT *, {m} || md5('b' || pk) AS m2, translate(substr(md5('d' || page_id), 1, 12), 'abcdef', '012345') AS digits12,
    substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21, 12) AS uuid, chr(34) AS q, chr(39) AS a
  FROM (SELECT *, md5(pk) AS m, md5('u' || page_id) AS u FROM (SELECT page_id, url, html, k, page_id || ':' || k AS pk FROM {pages}))
""".replace("{m}", "m")

TOKENS = {
    1: "'AK'||'IA'||upper(substr(m,1,16))",
    2: "'aws_secret_'||'access_key = '||q||substr(m2,1,40)||q",
    3: "'amzn'||'.mws.'||uuid",
    4: "'da'||'2-'||substr(m,1,26)",
    5: "'AI'||'za'||substr(m2,1,35)",
    6: "'client_'||'secret: '||q||substr(m,1,24)||q",
    7: "'{'||q||'type'||q||': '||q||'service_'||'account'||q||'}'",
    8: "'EAAC'||'EdEose0cBA'||m",
    9: "'face'||'book = '||q||m||q",
    10: "'sk_'||'live_'||upper(substr(m,1,26))",
    11: "'pk_'||'live_'||substr(m,1,24)",
    12: "'rk_'||'live_'||substr(m,1,24)",
    13: "'gh'||'p_'||substr(m2,1,36)",
    14: "'gh'||'o_'||substr(m2,1,36)",
    15: "'git'||'hub = '||q||substr(m2,1,40)||q",
    16: "'https://'||substr(m2,1,40)||'@git'||'hub.com/x'",
    17: "'hero'||'ku '||uuid",
    18: "m||'-us'||'12'",
    19: "'access_'||'token$production$'||substr(m,1,16)||'$'||m",
    20: "'sk_'||'live_'||m",
    21: "'sq0'||'atp-'||substr(m,1,22)",
    22: "'sq0'||'csp-'||substr(m2,1,43)",
    23: "digits12||':A'||'A'||substr(m2,1,33)",
    24: "'ey'||'J'||substr(m,1,12)||'.'||substr(m,5,12)||'.'||substr(m,9,12)",
    25: "'api'||'Key: '||q||substr(m,1,24)||q",
    26: "'to'||'ken = '||a||substr(m,1,24)||a",
    27: "'Sec'||'ret='||q||substr(m,1,22)||q",
    28: "'pass'||'word: '||q||substr(m,1,9)||q",
    29: "'ftp://user:pa'||substr(m,1,4)||'@h.example/p'||q",
    30: "'postgre'||'sql://u@h/'||substr(m,1,6)",
    31: "'my'||'sql://u@h/'||substr(m,1,6)",
    32: "'mongodb'||'+srv://u@h/'||substr(m,1,6)",
    33: "'re'||'dis://h:6379/'||substr(m,1,2)",
    34: "q||'/a/'||substr(m,1,6)||'/c.js'||q",
    35: "'https://h.example/'||substr(m,1,8)||'?x=1'",
    36: "'wss://h.example/'||substr(m,1,8)",
    37: "a||'/api/v1/'||substr(m,1,6)||'?x=1'||a",
    38: "q||'/v2/graphql/'||substr(m,1,4)||q",
    39: "q||'/admin/'||substr(m,1,6)||q",
    40: "'https://hooks.'||'slack.com/services/T'||substr(m,1,8)||'/B'||substr(m,9,8)||'/'||substr(m,1,24)",
    41: "'xo'||'xb-'||digits12||'-'||digits12||'-'||digits12||'-'||m",
    42: "'S'||'K'||m",
    43: "'S'||'G.'||substr(m,1,22)||'.'||substr(m2,1,43)",
    44: "'ke'||'y-'||m",
    45: "'-----BEGIN '||'RSA PRI'||'VATE KEY-----'",
}
CASES = " ".join(f"WHEN {k} THEN {t}" for k, t in TOKENS.items())
BODY = f"'x = 1;' || chr(10) || '  var v = ' || (CASE k {CASES} END) || ' ; // e' || chr(10)"


def corpus(numbers: str) -> str:
    """page_id, k, path, body for every page and rule; `numbers` is a relation of k from 1 to 45."""
    inner = VARIABLES.replace("FROM {pages}", f"FROM pages CROSS JOIN {numbers}")
    return f"SELECT page_id, k, 'planted:' || page_id || ':' || k AS path, {BODY} AS body FROM ({inner})"


def pages_with_scripts() -> str:
    """page_id, url, html: each page with one external and one inline script more, the latter with one rule's token."""
    inner = VARIABLES.replace("FROM {pages}", "FROM (SELECT *, 1 + page_id % 45 AS k FROM pages)")
    tags = f"'<script src=' || q || '/js/' || (page_id % 7) || '.js' || q || '></script><script>' || {BODY} || '</script></head>'"
    return f"SELECT page_id, url, replace(html, '</head>', {tags}) AS html FROM ({inner})"


def resources() -> str:
    """url, status, body: for each page's external script one answer; one script in seven is gone."""
    return "SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/js/' || (page_id % 7) || '.js' AS url, CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status, 'load(' || chr(34) || '/api/v' || (page_id % 7) || '/items' || chr(34) || ');' || chr(10) || 'go();' AS body FROM pages"
