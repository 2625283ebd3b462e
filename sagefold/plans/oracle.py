"""The same queries in SQL, for an engine of another make to hold the results against."""

from __future__ import annotations

from ..functions.text import ACK_PHRASES, BOT_LOGINS, STRUCTURAL_TAGS
from ..vocabulary import CATEGORIES, TIERS
from .catalogue import PRICES
from .surrogates import BODIES, NOW, REPOS


def _lit(s: str) -> str:
    """A literal; control characters as escapes."""
    out = s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"E'{out}'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(_lit(x) for x in xs) + "]"


def _rank(c: str, xs: list[str]) -> str:
    return f"coalesce(nullif(list_position({_list(xs)}, {c}), 0) - 1, {len(xs)})"


def trim_ws(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def one_line(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def normalize(c: str) -> str:
    return f"lower({one_line(c)})"


def clean(c: str) -> str:
    s = rf"regexp_replace(replace(coalesce({c}, ''), E'\r\n', E'\n'), '<!--.*?-->', '', 'gs')"
    s = rf"list_transform(list_filter(string_split({s}, E'\n'), lambda x: NOT regexp_matches(x, '^\s*>')), lambda x: regexp_replace(x, '[ \t]+$', ''))"
    return trim_ws(rf"regexp_replace(array_to_string({s}, E'\n'), '\n{{3,}}', E'\n\n', 'g')")


def ack(c: str) -> str:
    phrases = "|".join(p.replace("+", r"\+") for p in ACK_PHRASES)
    return f"regexp_matches(trim(regexp_replace(lower({c}), '[^a-z0-9+]+', ' ', 'g')), '^(?:(?:{phrases})(?: |$))+$')"


def commands(c: str) -> str:
    return rf"len(list_filter(string_split({c}, E'\n'), lambda x: {trim_ws('x')} <> '' AND NOT regexp_matches({trim_ws('x')}, '^/[a-z][a-z0-9_-]*(?:\s.*)?$'))) = 0"


def noise(c: str) -> str:
    b = trim_ws(c)
    return rf"({b} = '' OR {ack(b)} OR {commands(b)} OR NOT regexp_matches({b}, '[\p{{L}}\p{{Nd}}]'))"


def truncate(c: str, n: int, mark: str = " [...]") -> str:
    return f"CASE WHEN length({c}) > {n} THEN concat(substr({c}, 1, {n}), '{mark}') ELSE {c} END"


def tokens(c: str) -> str:
    return f"(strlen({c}) // 3 + 1)"


def slug(c: str, most: int = 60) -> str:
    return f"regexp_replace(substr(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), 1, {most}), '-+$', '')"


def role(login: str, kind: str, association: str, author: str) -> str:
    bots = ", ".join(_lit(b) for b in BOT_LOGINS)
    return f"CASE WHEN {kind} = 'Bot' OR ends_with(lower({login}), '[bot]') OR ends_with(lower({login}), '-bot') OR lower({login}) IN ({bots}) THEN 'bot' WHEN lower({login}) = lower({author}) THEN 'pr-author' WHEN {association} IN ('OWNER', 'MEMBER', 'COLLABORATOR') THEN 'maintainer' ELSE 'contributor' END"


EV = f"""
ev0 AS (
  SELECT concat(l_partkey, '-', l_linenumber) AS rule_id, l_partkey AS part,
    CASE WHEN l_discount >= 0.10 THEN 'opposing' ELSE 'support' END AS side, l_orderkey AS pr,
    concat(l_orderkey, '.', l_linenumber) AS ref, concat('https://x/', l_orderkey, '#', l_linenumber) AS url,
    CASE WHEN l_linenumber % 2 = 1 THEN upper(s_name) ELSE s_name END AS author,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'maintainer' WHEN '4-NOT SPECIFIED' THEN 'pr-author' WHEN '5-LOW' THEN 'bot' ELSE 'contributor' END AS role,
    CAST(l_shipdate AS TIMESTAMP) AS date,
    CASE WHEN l_returnflag = 'R' AND l_tax >= 0.06 THEN 'disputed' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'ignored' WHEN l_returnflag = 'A' THEN 'unclear' ELSE 'accepted' END AS outcome,
    CAST(trunc(l_quantity) AS INTEGER) % 6 AS thumbs_up, r_name AS repo
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ev AS (SELECT * FROM ev0 QUALIFY row_number() OVER (PARTITION BY rule_id, side, url ORDER BY pr, author, role, date, outcome, thumbs_up, repo) = 1)"""

METRICS = f"""
m AS (
  SELECT rule_id, min(part) AS part,
    count(DISTINCT concat(repo, '#', pr)) FILTER (side = 'support') AS distinct_prs,
    count(DISTINCT repo) FILTER (side = 'support') AS distinct_repos,
    CASE WHEN count(DISTINCT lower(author)) FILTER (side = 'support' AND role <> 'pr-author') > 0 THEN count(DISTINCT lower(author)) FILTER (side = 'support' AND role <> 'pr-author') ELSE count(DISTINCT lower(author)) FILTER (side = 'support') END AS distinct_reviewers,
    coalesce(bool_or(role = 'maintainer' AND outcome <> 'disputed') FILTER (side = 'support'), false) AS maintainer_endorsed,
    count(*) FILTER (side = 'support' AND outcome = 'accepted') AS accepted, count(*) FILTER (side = 'support' AND outcome = 'disputed') AS disputed,
    count(*) FILTER (side = 'support' AND outcome = 'ignored') AS ignored,
    CAST(coalesce(sum(thumbs_up) FILTER (side = 'support'), 0) AS BIGINT) AS thumbs_up,
    min(date) FILTER (side = 'support') AS first_seen, max(date) FILTER (side = 'support') AS last_seen,
    count(*) FILTER (side = 'support' AND {NOW} - date <= INTERVAL 365 DAYS) / count(*) FILTER (side = 'support') AS recent_share,
    count(DISTINCT url) FILTER (side = 'opposing') AS opposing
  FROM ev GROUP BY rule_id HAVING count(*) FILTER (side = 'support') > 0)"""

RULES = f"""
rules AS (
  SELECT m.*, p_name AS title, {_list(CATEGORIES)}[p_size % 12 + 1] AS category, CASE WHEN part % 2 = 0 THEN 'do' ELSE 'dont' END AS kind,
    CASE part % 5 WHEN 0 THEN 'conditional' WHEN 1 THEN 'consider' WHEN 2 THEN 'rejected' ELSE 'golden' END AS tier,
    CASE WHEN part % 3 = 0 THEN '' ELSE 'it applies' END AS applies_when, (part * 7 % 100) / 100.0::DOUBLE AS confidence
  FROM m JOIN part ON part = p_partkey)"""


def floors(src: str, out: str) -> str:
    """CTEs that put tiers on evidence floors."""
    contested = "(disputed + opposing > 0 AND (disputed + opposing) * 3 >= accepted)"
    return f"""
{out}1 AS (
  SELECT *, tier AS t0, tier = 'golden' AND distinct_prs < 3 AS few, tier = 'golden' AND distinct_reviewers < 2 AND NOT maintainer_endorsed AS alone, tier = 'golden' AND {contested} AS contested FROM {src}),
{out}2 AS (SELECT *, CASE WHEN few OR alone OR contested THEN 'conditional' ELSE t0 END AS t1 FROM {out}1),
{out}3 AS (SELECT *, t1 = 'conditional' AND trim(applies_when) = '' AS bare FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN bare THEN 'consider' ELSE t1 END AS t2 FROM {out}3),
{out}5 AS (SELECT *, t2 IN ('golden', 'conditional') AND distinct_prs <= 1 AND NOT maintainer_endorsed AS single FROM {out}4),
{out} AS (
  SELECT * EXCLUDE (tier), CASE WHEN single THEN 'consider' ELSE t2 END AS tier,
    CASE WHEN (CASE WHEN single THEN 'consider' ELSE t2 END) = t0 THEN '' ELSE concat('Downgraded from ', t0, ' by evidence floor: ',
      concat_ws('; ', CASE WHEN few THEN concat('only ', distinct_prs, ' PR(s)') END, CASE WHEN alone THEN 'a single non-maintainer reviewer' END, CASE WHEN contested THEN 'contested' END,
        CASE WHEN t0 = 'conditional' AND bare THEN 'no applies_when condition' END, CASE WHEN single THEN 'single PR without maintainer support' END), '.') END AS note
  FROM {out}5)"""


GRADED = f"{floors('rules', 'f')},\ngraded AS (SELECT * EXCLUDE (confidence), t0 AS original, CASE WHEN note <> '' THEN least(0.7, confidence) ELSE confidence END AS confidence FROM f)"
BASE = f"WITH {EV.strip()},{METRICS},{RULES},{GRADED}"

FEED = """
feed AS (
  SELECT o_orderkey AS pr, o_orderstatus AS state, CAST(o_orderdate AS TIMESTAMP) AS updated_at, 1 AS read_order FROM orders
  UNION ALL SELECT o_orderkey, 'L', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY, 2 FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 'S', CAST(o_orderdate AS TIMESTAMP), 3 FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0)"""
GENS = """
gens AS (
  SELECT gen, pr, substr(sha256(kind), 1, 16) AS hash, n FROM (
    SELECT CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 259200) AS BIGINT) AS gen, user_id AS pr, max_by(event_type, event_id) AS kind, count(*) AS n FROM events GROUP BY ALL))"""
TEXTS = f"""
texts AS (
  SELECT conv_id * 1000 + turn AS id, text AS body FROM conversations
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({-k - 1}, {_lit(b)})" for k, b in enumerate(BODIES))}))"""
TALK = f"""
talk0 AS (
  SELECT conv_id AS pr, turn AS idx, {clean("text")} AS body, {role("role", "CASE WHEN role = 'system' THEN 'Bot' ELSE 'User' END", "CASE WHEN role = 'assistant' THEN 'MEMBER' ELSE 'NONE' END", "'user'")} AS role,
    conv_id % 2 = 0 AS resolved, conv_id % 3 = 0 AS outdated FROM conversations),
talk AS (
  SELECT *, role <> 'bot' AND NOT {noise("body")} AS kept, role = 'bot' AS bot_dropped, role <> 'bot' AND {noise("body")} AS noise_dropped, idx > 0 AND role = 'pr-author' AND {ack("body")} AS ack FROM talk0)"""
REQUESTS = """
req AS (SELECT concat('o', o_orderkey, '-', substr(sha256(o_orderpriority), 1, 10)) AS id, o_orderkey AS k, o_orderkey % 50 AS gen FROM orders),
res AS (SELECT id, CASE WHEN k % 5 = 0 THEN 'timeout' ELSE '' END AS error FROM req WHERE k % 3 <> 0)"""


def packed(src: str, groups: str, order: str, limits: dict[str, int]) -> str:
    """Recursive CTEs that bin the rows of ``src`` greedily."""
    first = ", ".join(f"{c} AS s_{c}" for c in limits)
    over = " OR ".join(f"p.s_{c} + n.{c} > {most}" for c, most in limits.items())
    sums = ", ".join(f"CASE WHEN {over} THEN n.{c} ELSE p.s_{c} + n.{c} END" for c in limits)
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY {order}) AS rn FROM {src}),
packed AS (
  SELECT numbered.*, CAST(1 AS BIGINT) AS bin, {first} FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.*, CASE WHEN {over} THEN p.bin + 1 ELSE p.bin END, {sums} FROM packed p JOIN numbered n ON n.{groups} = p.{groups} AND n.rn = p.rn + 1)"""


PROBLEMS = f"""
broken AS (
  SELECT part, rule_id, CASE WHEN part % 41 = 0 THEN 'same' ELSE rule_id END AS id, CASE WHEN part % 13 = 0 THEN ' ' ELSE title END AS title, CASE WHEN part % 17 = 0 THEN 'other' ELSE category END AS category,
    CASE WHEN part % 19 = 0 THEN 'best' ELSE tier END AS tier, confidence + CASE WHEN part % 23 = 0 THEN 1.5 ELSE 0 END AS confidence, CASE WHEN part % 29 = 0 THEN '' ELSE applies_when END AS applies_when FROM graded),
bad AS (
  SELECT id, 'empty title or rule' AS problem FROM broken WHERE trim(title) = ''
  UNION ALL SELECT id, 'bad category' FROM broken WHERE category NOT IN (SELECT unnest({_list(CATEGORIES)}))
  UNION ALL SELECT id, 'bad tier' FROM broken WHERE tier NOT IN (SELECT unnest({_list(TIERS)}))
  UNION ALL SELECT id, 'confidence out of [0,1]' FROM broken WHERE NOT confidence BETWEEN 0 AND 1
  UNION ALL SELECT id, 'conditional rule without applies_when' FROM broken WHERE tier = 'conditional' AND trim(applies_when) = ''
  UNION ALL SELECT id, 'no evidence' FROM broken WHERE part % 43 = 0
  UNION ALL SELECT id, concat('evidence missing url or pr: ', rule_id) FROM broken WHERE part % 43 <> 0 AND (part % 31 = 0 OR part % 37 = 0)
  UNION ALL SELECT id, 'missing or duplicate id' FROM (SELECT id, unnest(range(count(*) - 1)) FROM broken GROUP BY id HAVING count(*) > 1))"""

EXPORTED = f"""
exported AS (
  SELECT *, rule_id AS id, row_number() OVER (ORDER BY {_rank("tier", TIERS)}, {_rank("category", CATEGORIES)}, rule_id) AS rank,
    CASE part % 4 WHEN 0 THEN concat('lib/', part % 5, E'\\nsrc/*.py') WHEN 1 THEN 'docs/' ELSE '' END AS key
  FROM graded WHERE tier <> 'rejected')"""

SPLIT = "lambda x: x <> ''"
URLS = f"""
urls AS (
  SELECT page_id AS id, {trim_ws("url")} AS s FROM pages UNION ALL SELECT id, {trim_ws("u")} FROM (VALUES {", ".join(f"({-k - 1}, {_lit(u)})" for k, u in enumerate(REPOS))}) v(id, u)),
cut AS (
  SELECT id, regexp_extract(s, '^([^/]*)/', 1) AS first, s FROM urls),
placed AS (
  SELECT id, CASE WHEN starts_with(s, 'git@') THEN regexp_extract(s, '^git@([^:]*):', 1) WHEN contains(s, '://') THEN regexp_extract(s, '://(?:[^/?#@]*@)?([^/?#]*)', 1) WHEN contains(first, '.') THEN first ELSE 'github.com' END AS host,
    list_filter(string_split(CASE WHEN starts_with(s, 'git@') THEN CASE WHEN contains(s, ':') THEN regexp_extract(s, '^git@[^:]*:(.*)$', 1) ELSE '' END WHEN contains(s, '://') THEN regexp_extract(s, '://[^/?#]*([^?#]*)', 1) WHEN contains(first, '.') THEN regexp_extract(s, '^[^/]*/(.*)$', 1) ELSE s END, '/'), {SPLIT}) AS parts FROM cut),
named AS (SELECT id, host, parts[1] AS owner, regexp_replace(parts[2], '\\.git$', '') AS name FROM placed),
fine AS (SELECT *, coalesce(regexp_matches(owner, '^[A-Za-z0-9_.-]+$') AND regexp_matches(name, '^[A-Za-z0-9_.-]+$'), false) AS ok FROM named)"""


def _month(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m'), '?')"


def _plural(c: str, noun: str) -> str:
    return f"concat({c}, CASE WHEN {c} = 1 THEN ' {noun}' ELSE ' {noun}s' END)"


METRICS_LINE = f"""concat_ws(' · ', {_plural("distinct_prs", "PR")}, {_plural("distinct_reviewers", "reviewer")}, CASE WHEN distinct_repos > 1 THEN {_plural("distinct_repos", "repo")} END,
    CASE WHEN maintainer_endorsed THEN 'maintainer-endorsed' END, CASE WHEN accepted > 0 THEN concat(accepted, ' accepted') END, CASE WHEN disputed + opposing > 0 THEN concat(disputed + opposing, ' pushback') END,
    CASE WHEN first_seen IS NOT NULL THEN CASE WHEN {_month("first_seen")} = {_month("last_seen")} THEN concat('seen ', {_month("first_seen")}) ELSE concat('seen ', {_month("first_seen")}, ' to ', {_month("last_seen")}) END END)"""

EXTRACT = f"""
refs AS (
  SELECT ref, pr, concat('Please  keep ', author, E' in\\n', repo, ' as it is') AS body, author, repo FROM ev
  QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rule_id, pr, author, role, date, outcome, thumbs_up, repo) = 1),
good AS (SELECT DISTINCT pr FROM refs WHERE pr % 17 <> 0 AND pr % 19 <> 0 AND pr % 13 <> 0),
cand AS (
  SELECT good.pr, concat('c', good.pr, '.1') AS id, concat('title ', good.pr) AS title, CASE WHEN good.pr % 2 = 0 THEN 'style' ELSE 'process' END AS category FROM good),
cited AS (SELECT cand.*, refs.ref, refs.body, refs.author FROM cand JOIN refs USING (pr)),
known AS (SELECT *, pr % 4 <> 1 AS found FROM cited WHERE pr % 10 <> 3),
complete AS (SELECT cand.pr, cand.pr % 9 <> 0 AND cand.pr % 10 <> 3 AS ok FROM cand),
facts AS (
  SELECT 'requests' AS k, count(DISTINCT pr) AS v FROM refs
  UNION ALL SELECT 'succeeded', count(*) FROM good
  UNION ALL SELECT 'failed', (SELECT count(DISTINCT pr) FROM refs) - (SELECT count(*) FROM good)
  UNION ALL SELECT 'candidates', count(*) FILTER (ok) FROM complete
  UNION ALL SELECT 'dropped', count(*) FILTER (NOT ok) FROM complete
  UNION ALL SELECT 'quotes_replaced', count(*) FILTER (NOT found) FROM known
  UNION ALL SELECT 'unknown_refs', count(*) + count(DISTINCT pr) FROM cited WHERE pr % 10 = 3)"""

GROUPS = """
p AS (SELECT p_brand, p_partkey, p_size, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"""


def oracle_sql() -> dict[str, str]:
    return {
        "evidence_metrics": f"{BASE} SELECT * EXCLUDE (part) FROM m",
        "tier_floors": f"{BASE} SELECT rule_id, original, tier, confidence, note FROM graded",
        "repo_floor_combined": f"""{BASE},
rp AS (SELECT rule_id, list_sort(list(DISTINCT repo)) AS repos FROM ev WHERE side = 'support' GROUP BY rule_id),
x AS (SELECT rules.*, repos, tier = 'golden' AND len(repos) <= 1 AS low FROM rules JOIN rp USING (rule_id) WHERE tier <> 'rejected')
SELECT rule_id, CASE WHEN low THEN 'conditional' ELSE tier END AS tier, CASE WHEN low AND trim(applies_when) = '' AND len(repos) = 1 THEN concat('In ', repos[1]) ELSE applies_when END AS applies_when,
  CASE WHEN low THEN 'Downgraded from golden: seen in a single repository.' ELSE '' END AS note, array_to_string(repos, ',') AS repos FROM x""",
        "top_evidence": f"""{BASE},
s AS (SELECT *, CASE WHEN role = 'maintainer' THEN 4 ELSE 0 END + CASE outcome WHEN 'accepted' THEN 3 WHEN 'unclear' THEN 1 ELSE 0 END + least(thumbs_up, 3) AS strength FROM ev WHERE side = 'support')
SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY strength DESC, date DESC NULLS LAST, url) AS rank, strength, url, date FROM s QUALIFY rank <= 5""",
        "finalize_rules": f"""{BASE},
k AS (SELECT *, row_number() OVER (ORDER BY {_rank("tier", TIERS)}, confidence DESC, distinct_prs DESC, rule_id) AS rank, {slug("title")} AS base FROM graded WHERE tier <> 'rejected'),
c AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank) AS n FROM k)
SELECT rank, CASE WHEN n = 1 THEN base ELSE concat(base, '-', n) END AS id, rule_id, tier, confidence, distinct_prs FROM c""",
        "tier_tally": f"{BASE} SELECT t.tier, count(graded.rule_id) AS n FROM (SELECT unnest({_list(TIERS)}) AS tier) t LEFT JOIN graded USING (tier) GROUP BY t.tier",
        "report_violations": f"{BASE},{PROBLEMS} SELECT id, problem, count(*) AS n FROM bad GROUP BY ALL",
        "export_filter_sort": f"{BASE},{EXPORTED} SELECT rank, id, tier, category FROM exported",
        "export_sections": f"""{BASE},{EXPORTED}
SELECT concat_ws('/', tier, category) AS name, string_agg(id, ',' ORDER BY rank) AS ids FROM exported GROUP BY tier, category
UNION ALL SELECT concat('rules-', category, '.md'), string_agg(id, ',' ORDER BY rank) FROM exported WHERE key = '' GROUP BY category
UNION ALL SELECT concat('rules-scoped-', {slug("replace(key, E'\\n', ' ')")}, '.md'), string_agg(id, ',' ORDER BY rank) FROM exported WHERE key <> '' GROUP BY key""",
        "rule_signature": f"{BASE} SELECT rule_id, concat(coalesce(string_agg(concat(url, '|', outcome, '|', role), ',' ORDER BY concat(url, '|', outcome, '|', role)) FILTER (side = 'support'), ''), '#opp=', count(DISTINCT url) FILTER (side = 'opposing')) AS signature FROM ev GROUP BY rule_id",
        "latest_pr_versions": f"WITH {FEED} SELECT pr, state, updated_at, read_order FROM feed QUALIFY row_number() OVER (PARTITION BY pr ORDER BY updated_at DESC, read_order) = 1",
        "incremental_refresh": f"""WITH {FEED}, b AS (SELECT max(updated_at) AS before FROM feed WHERE updated_at < TIMESTAMP '1998-01-01 00:00:00'), a AS (SELECT max(updated_at) AS after FROM feed)
SELECT pr, state, updated_at, read_order, before, after FROM feed, b, a WHERE updated_at >= before""",
        "dirty_units": """WITH u AS (SELECT doc_id AS pr, source AS repo, substr(sha256(concat(doc_id, E'\\n', coalesce(text, ''))), 1, 16) AS hash FROM documents)
SELECT pr, repo, hash FROM u WHERE NOT (pr % 3 = 0 AND pr % 2 <> 0)""",
        "latest_generation_evidence": f"WITH {GENS} SELECT gen, pr, hash, n FROM gens QUALIFY gen = max(gen) OVER (PARTITION BY pr)",
        "unfolded_candidates": f"WITH {GENS} SELECT gen, count(*) AS n FROM gens WHERE gen % 2 <> 0 GROUP BY gen",
        "clean_body": f"WITH {TEXTS} SELECT id, {clean('body')} AS body FROM texts",
        "noise_filter": f"WITH {TEXTS}, c AS (SELECT id, {clean('body')} AS body FROM texts) SELECT id, {ack('body')} AS ack, {commands('body')} AS commands, {noise('body')} AS noise FROM c",
        "role_classification": f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'Stale' WHEN c_custkey % 10 = 0 THEN concat(c_name, '-bot') ELSE c_name END AS login, c_mktsegment AS seg FROM customer),
x AS (SELECT o_orderkey, login, seg, CASE WHEN o_orderkey % 6 = 0 THEN upper(login) ELSE 'someone' END AS author, CASE WHEN o_orderstatus = 'F' THEN 'merged' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state FROM orders JOIN c ON o_custkey = c_custkey)
SELECT o_orderkey, {role("login", "CASE WHEN seg = 'MACHINERY' THEN 'Bot' ELSE 'User' END", "CASE WHEN seg = 'BUILDING' THEN 'OWNER' WHEN seg = 'AUTOMOBILE' THEN 'MEMBER' ELSE 'NONE' END", "author")} AS role, state FROM x""",
        "thread_outcomes": f"""WITH {TALK}, t AS (SELECT pr, bool_or(resolved) AS r, bool_or(outdated) AS o, bool_or(ack) OR pr % 5 = 0 AS a, count(*) FILTER (kept) AS comments FROM talk GROUP BY pr)
SELECT pr, coalesce(nullif(concat_ws(',', CASE WHEN r THEN 'resolved' END, CASE WHEN o THEN 'code-changed' END, CASE WHEN a THEN 'author-acknowledged' END), ''), 'unresolved') AS outcome, comments FROM t WHERE comments > 0""",
        "comment_refs": f"WITH {TALK}, k AS (SELECT pr, idx, concat(pr, '.', row_number() OVER (PARTITION BY pr ORDER BY idx)) AS ref, role, bool_or(role <> 'pr-author') OVER (PARTITION BY pr) AS ext FROM talk WHERE kept) SELECT pr, idx, ref, role FROM k WHERE ext",
        "digest_stats": f"""WITH {TALK}, e AS (SELECT pr FROM talk WHERE kept GROUP BY pr HAVING bool_or(role <> 'pr-author'))
SELECT (SELECT count(DISTINCT pr) FROM talk) AS prs_in, (SELECT count(*) FROM e) AS prs_kept, (SELECT count(*) FROM e) AS threads, count(*) FILTER (kept) AS comments, count(*) FILTER (noise_dropped) AS dropped_noise, count(*) FILTER (bot_dropped) AS dropped_bots FROM talk""",
        "path_areas": """WITH x AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS b, replace(p_type, ' ', '/') AS t FROM part),
d AS (SELECT p_partkey, unnest([concat(b, '/', t), '', b, t, concat(b, '/', t)]) AS dir, unnest(range(5)) AS k FROM x),
a AS (SELECT p_partkey, CASE WHEN dir = '' THEN '/' ELSE array_to_string(list_slice(string_split(dir, '/'), 1, 2), '/') END AS area, min(k) AS k FROM d GROUP BY ALL)
SELECT p_partkey, string_agg(area, ',' ORDER BY k) AS areas FROM a GROUP BY p_partkey""",
        "token_estimate": f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS b FROM documents), y AS (SELECT *, {one_line("b")} AS o FROM x)
SELECT doc_id, CAST({tokens("b")} AS INTEGER) AS tokens, CAST(length({truncate("b", 1500)}) AS INTEGER) AS body_chars, md5({truncate("b", 1500)}) AS body_md5, md5({truncate("o", 200, "…")}) AS quote_md5 FROM y""",
        "pack_chunks": f"""WITH RECURSIVE src AS (SELECT doc_id, coalesce(source, '') AS repo, CAST({tokens("coalesce(text, '')")} AS BIGINT) AS tokens FROM documents),{packed("src", "repo", "doc_id", {"tokens": 4000})}
SELECT repo, bin, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS parts, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM packed GROUP BY repo, bin""",
        "split_parts": f"""WITH RECURSIVE src AS (SELECT conv_id AS pr, turn, CAST({tokens("coalesce(text, '')")} AS BIGINT) AS tokens FROM conversations),{packed("src", "pr", "turn", {"tokens": 60})}
SELECT pr, turn, tokens, bin AS part FROM packed""",
        "group_items": f"""WITH RECURSIVE src AS (SELECT p_partkey AS k, p_brand AS category, CAST(strlen(p_name) AS BIGINT) AS size, CAST(1 AS BIGINT) AS one FROM part),{packed("src", "category", "k", {"one": 7, "size": 120})}
SELECT k, category, bin, CAST((rn - 1) // 150 AS BIGINT) AS fixed FROM packed""",
        "request_ids": """WITH x AS (SELECT p_partkey, concat('g0001-chunk-', lpad(CAST(p_partkey AS VARCHAR), 5, '0')) AS chunk, substr(sha256(p_name), 1, 10) AS h, p_brand FROM part)
SELECT p_partkey, concat(chunk, '-', h) AS request, chunk, regexp_replace(p_brand, '^(.+)-[^-]*$', '\\1') AS bare FROM x""",
        "unsent_requests": f"""WITH {REQUESTS}
SELECT id, 'unsent' AS state FROM req WHERE id NOT IN (SELECT id FROM res WHERE error = '') AND k % 7 <> 0
UNION ALL SELECT req.id, CASE WHEN res.id IS NULL THEN 'missing' ELSE error END FROM req LEFT JOIN res USING (id) WHERE res.id IS NULL OR error <> ''""",
        "extract_parse": f"""{BASE},{EXTRACT}
SELECT known.id, title, category, 'prefer' AS kind, 'a/' AS paths, ref, CASE WHEN found THEN concat('"KEEP ', author, ' in"') ELSE {one_line("body")} END AS quote, CASE WHEN pr % 6 = 0 THEN 'unclear' ELSE 'accepted' END AS outcome
FROM known JOIN complete USING (pr) WHERE ok
UNION ALL SELECT concat('#', k), CAST(v AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL FROM facts""",
        "quote_verification": f"SELECT doc_id, item_id FROM documents, benchmark WHERE contains({normalize('documents.text')}, trim({normalize('benchmark.text')}, '\"''.… ')) AND trim({normalize('benchmark.text')}, '\"''.… ') <> ''",
        "merge_apply": f"""WITH {GROUPS},
a AS (SELECT *, CASE WHEN p_size % 8 = 0 THEN 0 WHEN p_size % 8 = 7 THEN NULL WHEN p_size % 8 = 1 THEN 1 END AS own, max(n) OVER (PARTITION BY p_brand) AS last FROM p),
r AS (
  SELECT p_brand, j, list(p_partkey) FILTER (p_size % 8 = j OR (j = 0 AND p_size % 8 = -1) OR (j = 1 AND false)) AS mem, list(p_partkey) FILTER (p_size % 8 = 6 + j) AS opp FROM p, (VALUES (0), (1)) v(j) GROUP BY p_brand, j),
alive AS (SELECT * FROM r WHERE mem IS NOT NULL),
used AS (SELECT p_brand, unnest(list_concat(mem, coalesce(opp, []))) AS p_partkey FROM alive),
gone AS (SELECT DISTINCT p.p_brand, p.p_partkey FROM p JOIN a USING (p_brand, p_partkey) LEFT JOIN used USING (p_brand, p_partkey) WHERE a.n = a.last AND used.p_partkey IS NULL),
leftover AS (SELECT p.* FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM used) AND p_partkey NOT IN (SELECT p_partkey FROM gone)),
counts AS (SELECT b.p_brand, CAST((SELECT count(*) FROM gone WHERE gone.p_brand = b.p_brand) AS INTEGER) AS discarded, CAST((SELECT count(*) FROM leftover l WHERE l.p_brand = b.p_brand) AS INTEGER) AS unassigned FROM (SELECT DISTINCT p_brand FROM p) b),
made AS (
  SELECT p_brand, concat('rule ', j) AS title, list_transform(mem, lambda x: concat('c', x)) AS members, list_transform(coalesce(opp, []), lambda x: concat('c', x)) AS opposing, concat('reason ', j) AS rationale, 'worse/better' AS examples, concat('src/', j, '/,lib/') AS paths, 'go' AS languages FROM alive
  UNION ALL SELECT p_brand, p_name, [concat('c', p_partkey)], [], 'own reason', '/', '', '' FROM leftover)
SELECT p_brand, title, CAST(len(members) AS INTEGER) AS n_members, array_to_string(list_sort(members), ',') AS members, array_to_string(list_sort(opposing), ',') AS opposing, rationale, examples, paths, languages, discarded, unassigned FROM made JOIN counts USING (p_brand)""",
        "fold_apply": f"WITH {GROUPS} SELECT p_brand, CAST(CASE WHEN p_size % 5 BETWEEN 1 AND 3 THEN p_size % 5 ELSE 2 END AS INTEGER) AS rule, p_size % 6 = 0 AS opposing, concat('c', p_partkey) AS id FROM p",
        "score_apply": f"""{BASE},
n0 AS (SELECT * EXCLUDE (applies_when, tier, confidence), tier AS own, confidence AS conf, applies_when AS cond, part % 10 <> 9 AS selected, part % 6 = 0 AS once, part % 6 <> 0 AND part % 11 = 0 AS never FROM rules),
n1 AS (SELECT *, selected AND (never OR (NOT once AND part % 7 = 0)) AS lost, selected AND NOT never AS graded FROM n0),
n2 AS (
  SELECT *, CASE WHEN lost THEN 'consider' WHEN graded AND once THEN 'golden' ELSE own END AS tier, CASE WHEN lost THEN 0.3 WHEN graded AND once THEN 1.0 ELSE conf END AS confidence,
    CASE WHEN graded THEN 'in one case' ELSE cond END AS applies_when, CASE WHEN lost THEN 'The scorer returned no grade for this rule.' WHEN graded THEN 'because' ELSE 'old' END AS tier_reason FROM n1),{floors("n2", "g")}
SELECT rule_id, tier, CASE WHEN note <> '' THEN least(0.7, confidence) ELSE confidence END AS confidence, applies_when, CASE WHEN note <> '' THEN concat(tier_reason, ' ', note) ELSE tier_reason END AS tier_reason FROM g""",
        "cost_estimate": f"""WITH prices(model, pi, po) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICES)}),
x AS (SELECT coalesce(source, '') AS repo, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'large' ELSE 'small' END AS model, CAST(floor({tokens("coalesce(text, '')")} * 1.25::DOUBLE) AS BIGINT) AS t FROM documents),
s AS (SELECT repo, model, count(*) AS requests, CAST(sum(t) AS BIGINT) AS input_tokens, count(*) * 5000 AS output_tokens FROM x GROUP BY ALL),
c AS (SELECT s.*, pi IS NOT NULL AS known_price, coalesce(input_tokens / 1e6 * pi + output_tokens / 1e6 * po, 0) AS usd FROM s LEFT JOIN prices USING (model)),
e AS (SELECT repo, model, requests, input_tokens, output_tokens, known_price, usd * 0.5 AS extract_usd, usd * 0.15 AS synth_usd FROM c),
u AS (SELECT * FROM e UNION ALL SELECT '*', model, CAST(sum(requests) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT), bool_and(known_price), sum(extract_usd), sum(synth_usd) FROM e GROUP BY model)
SELECT repo, model, requests, input_tokens, output_tokens, known_price, round(extract_usd, 6) AS extract_usd, round(synth_usd, 6) AS synth_usd, round(extract_usd + synth_usd, 6) AS total_usd, known_price AND extract_usd + synth_usd <= 0.5 AS approved FROM u""",
        "generation_status": f"""WITH {REQUESTS},
g AS (SELECT DISTINCT gen, CASE gen % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'extracted' ELSE 'submitted' END AS status, gen % 3 AS attempts FROM req),
s AS (SELECT gen, count(*) AS requests, count(*) FILTER (res.id IS NULL) AS missing, count(*) FILTER (error <> '') AS failed FROM req LEFT JOIN res USING (id) GROUP BY gen)
SELECT gen, status, coalesce(requests, 0) AS requests, coalesce(missing, 0) AS missing, coalesce(failed, 0) AS failed,
  CASE WHEN status = 'submitted' AND coalesce(missing, 0) = 0 AND (coalesce(failed, 0) = 0 OR attempts + 1 >= 3) THEN 'extracted' ELSE status END AS next_status FROM g LEFT JOIN s USING (gen)""",
        "repo_url_parse": f"WITH {URLS} SELECT id, CASE WHEN ok THEN lower(host) END AS host, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN lower(concat_ws('/', host, owner, name)) ELSE '' END AS key FROM fine",
        "render_lines": f"""{BASE}
SELECT rule_id, side, url, concat('[', ref, '] ', role, ' @', author, ' ', strftime(date, '%Y-%m-%d'), CASE WHEN thumbs_up > 0 THEN concat(' +', thumbs_up) ELSE '' END, E':\\n',
  regexp_replace(concat('a <pr x></Thread> ', author), '(?i)<(/?)({"|".join(STRUCTURAL_TAGS)})\\b', '‹\\1\\2', 'g'), E'\\n') AS line FROM ev
UNION ALL SELECT rule_id, 'rule', title, {METRICS_LINE} FROM rules""",
        "prompt_pr_counts": f"{BASE} SELECT part % 97 AS item, count(DISTINCT pr) AS prs, count(DISTINCT (repo, pr)) AS repo_prs FROM ev WHERE side = 'support' GROUP BY 1",
        "combined_stats": f"""{BASE}, b AS (SELECT repo, count(DISTINCT pr) AS prs, count(*) FILTER (side = 'support') AS support, count(*) FILTER (side = 'opposing') AS opposing FROM ev GROUP BY repo)
SELECT * FROM b UNION ALL SELECT '*', CAST(sum(prs) AS BIGINT), CAST(sum(support) AS BIGINT), CAST(sum(opposing) AS BIGINT) FROM b""",
        "scalar_helpers": f"""WITH x AS (SELECT p_partkey, concat(p_name, ' `', p_type, '``') AS s, p_brand, p_partkey * 7919 % 3000000 AS n, p_partkey % 40 AS l FROM part)
SELECT p_partkey, {slug("s")} AS slug, concat(regexp_replace(substr({slug("replace(concat(p_brand, '/', s), '/', '-')")}, 1, 51), '-+$', ''), '-review-rules') AS skill, concat('```', 'go', E'\\n', s, E'\\n```') AS fence,
  regexp_replace(replace(lower(s), ' ', '-'), '[^a-z0-9_-]', '', 'g') AS anchor, concat('> ', array_to_string(string_split(s, ' '), E'\\n> ')) AS quote,
  CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.0fk', n / 1e3) ELSE CAST(n AS VARCHAR) END AS human, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END AS INTEGER) AS rank, CAST(CASE WHEN l BETWEEN 1 AND 30 THEN l END AS INTEGER) AS local FROM x""",
        "flagship": f"""{BASE},
s AS (SELECT *, CASE WHEN role = 'maintainer' THEN 4 ELSE 0 END + CASE outcome WHEN 'accepted' THEN 3 WHEN 'unclear' THEN 1 ELSE 0 END + least(thumbs_up, 3) AS strength FROM ev WHERE side = 'support'),
t AS (SELECT rule_id, url, row_number() OVER (PARTITION BY rule_id ORDER BY strength DESC, date DESC NULLS LAST, url) AS r FROM s QUALIFY r <= 5),
b AS (SELECT rule_id, string_agg(url, ' ' ORDER BY r) AS evidence FROM t GROUP BY rule_id),
k AS (SELECT *, row_number() OVER (ORDER BY {_rank("tier", TIERS)}, confidence DESC, distinct_prs DESC, rule_id) AS rank, {slug("title")} AS base FROM graded WHERE tier <> 'rejected'),
c AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank) AS n FROM k)
SELECT rank, CASE WHEN n = 1 THEN base ELSE concat(base, '-', n) END AS id, tier, confidence, category, distinct_prs, note, evidence FROM c LEFT JOIN b USING (rule_id)""",
    }


