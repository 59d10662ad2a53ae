"""The seeded corpus: the documents table laid out as projects of files.

Raw documents trip almost no rule, so snippets that do are appended.  The
statement runs unchanged in Spark SQL and other engines; ``|`` stands for a new
line, and key-shaped strings are built with repeat().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscan.sources.files import files_from_table

SEEDED_FILES_SQL = r'''
WITH snip(cls, sid, body) AS (VALUES
 ('py',0,'total = eval(form["sum"])|exec(plan)'),
 ('py',1,'API_KEY = "sk-' || repeat('a1B2',13) || '"'),
 ('py',2,'temperature = 0.35|base_url = "https://llm.internal.test"'),
 ('py',3,'prompt = f"Summarise this ticket: {user_input}"'),
 ('py',4,'def load(p):|    f = open(p)|    return f.read()'),
 ('py',5,'def run(x: int) -> int:|    """doc"""|    try:|        return x|    except Exception:|        raise'),
 ('py',6,'try:|    go()|except:|    stop()'),
 ('py',7,'import openai|for row in backlog:|    llm.chat.completions.create(model=NAME, functions=specs)'),
 ('py',8,'import os|os.system(cmd)|subprocess.run(cmd)|subprocess.Popen(c)|subprocess.call(c)'),
 ('py',9,'import pickle|pickle.loads(b)|pickle.load(f)|yaml.load(s)|marshal.loads(b)|shelve.open(p)|__import__(m)|compile(s)'),
 ('py',10,'requests.get("http://x.example.com/api/login", verify=False)|ssl._create_unverified_context()'),
 ('py',11,'logging.info("the token is", token)|print("password", password)'),
 ('py',12,'name = input("who")|msg = "hello " + user'),
 ('py',13,'password = "' || repeat('hunter2',2) || '"|aws = "AKIA' || repeat('AB12',4) || '"'),
 ('py',14,'k = "gh' || 'p_' || repeat('aB3d',9) || '"|t = "xo' || 'xb-' || repeat('1a',8) || '"'),
 ('py',15,'if sys.platform == "win32":|    tool_choice = 1|    top_k = 4|    azure_endpoint = 2'),
 ('py',16,'import vertexai|x = "bedrock-runtime"|response_format = {"type": "json_schema"}'),
 ('py',17,repeat('if a and b or c:|    pass|',12)),
 ('py',18,'import asyncio|async def go():|    cache = {}|    r = await client.messages.create(stream=True)|    return validate(r)'),
 ('py',19,'t = "text".format(user)|u = "%s" % query|Template(x).render()'),
 ('py',20,'a = "sk-' || 'ant-' || repeat('aB1c',9) || '"|j = "ey' || 'J' || repeat('aB1c',4) || '.ey' || 'J' || repeat('aB1c',4) || '.' || repeat('aB1c',4) || '"|s = "sk' || '_live_' || repeat('aB1c',7) || '"'),
 ('py',21,'g = "AI' || 'za' || repeat('aB1cD',7) || '"|h = "https://hooks.' || 'slack.com/services/T' || repeat('A1',4) || '/B' || repeat('A1',4) || '/' || repeat('aB',6) || '"|p = "-----BEGIN ' || 'RSA PRIVATE KEY-----"'),
 ('prompt',0,'You are an expert.|1. Read|2. Return JSON output'),
 ('prompt',1,'Please help me with the following.|maybe guess'),
 ('prompt',2,'Act as a helper. Do not fabricate.|probably ok'),
 ('prompt',3,'same line|same line|same line|same line|same line|same line'),
 ('prompt',4,'# Title|## install|## example|license: x'),
 ('prompt',5,'Step 1 output markdown.'),
 ('dep',0,'requests==2.0|flask==1.0'),
 ('dep',1,'numpy'),
 ('dep',2,'Django|urllib3|jinja2'),
 ('dep',3,'attrs==23.1'),
 ('dep',4,'click|rich'),
 ('cfg',0,'{"mcpServers": {"filesystem": ["read", "write"]}}'),
 ('cfg',1,'{"version": "1.0"}'),
 ('cfg',2,'{"api_key": "' || repeat('abcd',5) || '"}'),
 ('other',0,'*.pyc')),
d AS (SELECT doc_id, text, CAST(floor(doc_id / 8) AS BIGINT) AS pid, CAST(doc_id % 8 AS INT) AS r FROM documents),
base AS (SELECT *, CASE r
   WHEN 0 THEN CASE WHEN pid % 3 = 0 THEN 'README.md' ELSE 'docs/notes.txt' END
   WHEN 1 THEN CASE WHEN pid % 5 = 0 THEN 'lib/io.py' ELSE 'system_prompt.md' END
   WHEN 2 THEN 'main.py'
   WHEN 3 THEN CASE WHEN pid % 2 = 0 THEN 'tests/test_main.py' ELSE 'src/util.py' END
   WHEN 4 THEN CASE WHEN pid % 4 = 0 THEN 'src/tool_runner.py' WHEN pid % 4 = 1 THEN 'src/agent.js' ELSE 'src/core.py' END
   WHEN 5 THEN CASE WHEN pid % 6 = 0 THEN 'mcp.json' WHEN pid % 6 = 1 THEN 'settings.yaml' ELSE 'config.json' END
   WHEN 6 THEN CASE WHEN pid % 3 = 1 THEN 'CHANGELOG.md' ELSE 'requirements.txt' END
   ELSE CASE WHEN pid % 2 = 0 THEN '.gitignore' ELSE '__init__.py' END END AS plain FROM d),
p AS (SELECT *, CASE pid % 13 WHEN 5 THEN replace(plain, '.py', '.md') WHEN 7 THEN 'retriever/' || plain WHEN 9 THEN 'f' || r || '.bin'
   ELSE plain END AS path FROM base),
c AS (SELECT *, CASE WHEN path LIKE '%.py' OR path LIKE '%.js' THEN 'py' WHEN path = 'requirements.txt' THEN 'dep'
   WHEN path LIKE '%.json' OR path LIKE '%.yaml' THEN 'cfg' WHEN path = '.gitignore' THEN 'other' ELSE 'prompt' END AS cls FROM p),
k AS (SELECT *, CASE cls WHEN 'py' THEN 22 WHEN 'prompt' THEN 6 WHEN 'dep' THEN 5 WHEN 'cfg' THEN 3 ELSE 1 END AS n FROM c),
t AS (SELECT k.pid, (k.pid * 5 + k.r) % 17 AS v, k.path, k.text || chr(10) || replace(a.body, '|', chr(10)) || chr(10) || replace(b.body, '|', chr(10)) AS body
FROM k JOIN snip a ON a.cls = k.cls AND a.sid = (k.pid * 7 + k.r) % k.n
       JOIN snip b ON b.cls = k.cls AND b.sid = (k.pid * 3 + k.r * 5 + 1) % k.n)
SELECT pid AS project_id, path, CASE WHEN v = 6 AND pid % 3 = 0 THEN '' ELSE
   replace(replace(body, chr(10), CASE v WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END),
     CASE v WHEN 3 THEN ' the ' WHEN 4 THEN ' de ' ELSE ' no such words ' END, CASE v WHEN 3 THEN ' the' || chr(12) WHEN 4 THEN '  de ' ELSE '' END)
   || CASE v WHEN 2 THEN '' WHEN 5 THEN chr(10) || ' ' || chr(11) || chr(10) ELSE chr(10) END END AS content
FROM t
'''

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The given tables are one row group each; a session may ask for more
    tasks (the benchmark does).  By default rows stay where they are read."""
    n = spark.conf.get("folioscan.partitions", None)
    return files_from_table(files, "project_id", "path", "content", int(n) if n else None)


def seeded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, seeded_from(table(spark, sf_dir, "documents")))


def seeded_from(documents: DataFrame) -> DataFrame:
    """The corpus of any documents(doc_id, text) frame, also a streaming one."""
    view = f"documents_{uuid.uuid4().hex}"
    documents.createOrReplaceTempView(view)
    return documents.sparkSession.sql(SEEDED_FILES_SQL.replace("FROM documents)", f"FROM {view})"))


# Conversations as projects of one file per turn; the folder and ending depend
# on the conversation, so that every skill type occurs.
CONVERSATION_FILES_SQL = r"""
SELECT 'conv-' || CAST(conv_id AS STRING) AS project_id,
       CASE conv_id % 7 WHEN 0 THEN 'retriever/' WHEN 1 THEN 'workflow/' WHEN 2 THEN 'tools/' WHEN 3 THEN 'notes/'
            WHEN 4 THEN 'mcp_config/' WHEN 5 THEN '' ELSE 'data/' END
       || 'turn_' || CAST(turn AS STRING)
       || CASE conv_id % 7 WHEN 2 THEN '.py' WHEN 3 THEN CASE WHEN turn = 0 THEN '.py' ELSE '.md' END
            WHEN 4 THEN '.yaml' WHEN 5 THEN '.TXT' WHEN 6 THEN '.toml' ELSE '.md' END AS path,
       CASE WHEN conv_id % 14 = 6 THEN 'You are a helper. These INSTRUCTIONS say: ' ELSE '' END || text AS content
FROM conversations
"""

# Projects a and b have files of the same paths.
SHARED_PATHS_SQL = r"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS project_id,
       'doc_' || CAST(floor(doc_id / 2) AS INT) || CASE WHEN doc_id % 6 < 2 THEN '.py' ELSE '.md' END AS path, text AS content FROM documents
"""

# Some files of the seeded corpus could not be read.
UNREADABLE_FILES_SQL = r"""
SELECT project_id, path, CASE WHEN length(content) % 17 = 0 THEN NULL ELSE content END AS content FROM seeded_files
"""

# The corpus as it was at an earlier audit: main.py has changed since in some projects.
EARLIER_FILES_SQL = r"""
SELECT project_id, path,
       CASE WHEN path = 'main.py' AND length(content) % 3 = 0 THEN content || 'x = 1' ELSE content END AS content
FROM seeded_files
"""

# Recorded judge answers: good, partial, wrapped in prose, broken and missing.
RESPONSES_SQL = r"""
SELECT project_id, 'P' AS judge,
  CASE CAST(n % 6 AS INT)
    WHEN 0 THEN '{"clarity": {"score": ' || CAST(n % 101 AS STRING) || ', "reason": "vague"}, "specificity": {"score": 61.5}, "injection_risk": {"score": 20, "reason": "joined input", "vulnerable_lines": ["a = b + user", "c", "d", "e"]}}'
    WHEN 1 THEN 'Here it is:' || chr(10) || '{"clarity": {"score": 77, "reason": ""}, "overall_comment": "fine"} Thanks.'
    WHEN 2 THEN '{"clarity": {"score": "90"}, "specificity": 5}'
    WHEN 3 THEN 'no json here'
    WHEN 4 THEN '{"clarity": {"score": 10'
    ELSE '{}' END AS raw,
  CASE CAST(n % 6 AS INT) WHEN 3 THEN 'error: timeout' ELSE 'success' END AS status,
  CAST(n AS INT) AS input_tokens, 50 AS output_tokens, CAST(n * 13 % 997 AS INT) AS latency_ms, CAST(n % 3 AS INT) AS retries
FROM (SELECT project_id, sum(length(content)) AS n FROM seeded_files GROUP BY project_id) s
UNION ALL
SELECT project_id, 'C',
  CASE CAST(n % 4 AS INT)
    WHEN 0 THEN '{"hallucination_risk": {"score": ' || CAST(n % 101 AS STRING) || ', "reason": "asks to guess"}, "risk_patterns": ["maybe guess", "make up"], "suggestions": []}'
    WHEN 1 THEN '{"hallucination_risk": {"score": 88.5, "reason": ""}}'
    WHEN 2 THEN '}{'
    ELSE '{"risk_patterns": []}' END,
  'success', CAST(n AS INT), 40, CAST(n * 7 % 997 AS INT), 0
FROM (SELECT project_id, sum(length(content)) AS n FROM seeded_files GROUP BY project_id) s
"""


def query(sql: str, **frames: DataFrame) -> DataFrame:
    """Runs one of the statements above; each table name gets its frame."""
    for name, frame in frames.items():
        view = f"{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(view)
        sql = sql.replace(f"FROM {name}", f"FROM {view}")
        spark = frame.sparkSession
    return spark.sql(sql)


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, query(CONVERSATION_FILES_SQL, conversations=table(spark, sf_dir, "conversations")))


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(UNREADABLE_FILES_SQL, seeded_files=seeded_files(spark, sf_dir))


def earlier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(EARLIER_FILES_SQL, seeded_files=seeded_files(spark, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(RESPONSES_SQL, seeded_files=seeded_files(spark, sf_dir))
