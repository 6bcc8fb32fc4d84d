"""The domain workload: the documents' whole texts with sentences of privacy notices around them, each in a context of age and
jurisdiction. The domain's words don't occur in the documents, so sentences that have them are added: from one to MOST, their
number and choice by the id, half of them before the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import GRID

SENTENCES = (
    "We collect your email address to run the service.",
    "Consent of the holder of parental responsibility is asked for first.",
    "You may withdraw at any time.",
    "We may sell your profile to advertising partners.",
    "Your messages are stored indefinitely.",
    "We retain logs for 12 months.",
    "A retention schedule is published.",
    "This page was last updated in spring.",
    "We do not sell data to third parties.",
    "When you sign up, we process your name.",
    "Backups are retained as long as the account exists.",
    "Photos are stored for 30 days!",
    "Is parental approval needed?",
    "Children under the age of 13 need help.",
    "You must be 16 years old to chat.",
    "Please read this notice, and keep a copy; but do not share it.",
)
MOST = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(docs: DataFrame) -> DataFrame:
    """(doc_id, text, age, jurisdiction) of every document with an id; a null text, or none, adds nothing."""
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    d = docs.filter("doc_id is not null").select("doc_id", text.alias("own"))
    every = F.array(*map(F.lit, SENTENCES))
    picks = [F.when(F.expr(f"pmod(doc_id * 5 + doc_id div 9, {MOST}) >= {s}"), F.element_at(every, (F.expr(f"pmod(doc_id * {2 * s + 7} + {s * 11} + (doc_id div 16) * {s + 1}, {len(SENTENCES)})") + 1).cast("int"))) for s in range(MOST)]
    cell = F.expr("cast(pmod(doc_id, 9) as int) + 1")
    return d.select("doc_id", F.concat_ws(" ", *picks[::2], "own", *picks[1::2]).alias("text"), F.element_at(F.array(*[F.lit(a) for a, _ in GRID]), cell).alias("age"), F.element_at(F.array(*[F.lit(j) for _, j in GRID]), cell).alias("jurisdiction"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PICKS = [f"case when (doc_id * 5 + doc_id // 9) % {MOST} >= {s} then ([{', '.join(map(_quoted, SENTENCES))}])[((doc_id * {2 * s + 7} + {s * 11} + (doc_id // 16) * {s + 1}) % 16 + 1)::int] end" for s in range(MOST)]
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chain(base: str, mark: str = "") -> str:
    """The tables made from texts, for the oracle: a text's sentences, what each says, its graph, and what fires. base: a table of
    (doc_id, text, age, jurisdiction); mark: the end of the tables' names."""
    return f"""
sent{mark} as materialized (
  select doc_id, age, jurisdiction, i - 1 as sent_idx, parts[i] as s, lower(parts[i]) as low
  from (select *, list_filter(list_transform(string_split(regexp_replace(trim(text, {_BLANK}), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x, {_BLANK})), lambda x: x <> '') as parts from {base}), unnest(generate_series(1, len(parts))) as t(i)),
mark{mark} as (
  select *, contains(low, 'parental') as parental, contains(low, 'withdraw') as withdraw,
    contains(low, 'sell') and (contains(low, 'third part') or contains(low, 'advertising') or contains(low, 'partners')) as sale,
    contains(low, 'retain') or contains(low, 'retention') or contains(low, 'stored') as retain,
    contains(low, 'indefinit') or contains(low, 'as long as') or contains(low, 'no expir') as endless_word,
    regexp_matches(low, '\\b\\d+\\s*(month|year|day)') as bounded_word,
    regexp_matches(low, 'we |our service|our app|the operator|the company|this service|this app') and regexp_matches(low, 'process|collect|use your|uses your|using your') as operates
  from sent{mark}),
say{mark} as materialized (
  select *, contains(low, 'collect') or contains(low, 'personal information') or contains(low, 'consent') or contains(low, 'sign up') or contains(low, 'process') or parental or withdraw as backbone,
    retain and endless_word as endless, retain and not endless_word and bounded_word as bounded
  from mark{mark}),
g{mark} as materialized (
  select doc_id, any_value(age) as age, any_value(jurisdiction) as jurisdiction, bool_or(backbone) as bb, bool_or(parental) as pc, bool_or(withdraw) as wd, min(case when backbone then sent_idx end) as bb_idx,
    sum(sale::int) as sale, sum(endless::int) as ind, sum(bounded::int) as bnd, sum(retain::int) as ret, sum(parental::int) as n_pc, sum(withdraw::int) as n_wd, sum(operates::int) as n_op, bool_or(backbone or operates) as bb_op
  from say{mark} group by doc_id),
nodes{mark} as (
  select doc_id, 'DataSubject' as node_type, bb_idx as sent_idx from g{mark} where bb union all select doc_id, 'ConsentProcess', bb_idx from g{mark} where bb union all select doc_id, 'DataProcessing', bb_idx from g{mark} where bb
  union all select doc_id, 'ParentalConsent', sent_idx from say{mark} where parental union all select doc_id, 'Withdrawal', sent_idx from say{mark} where withdraw
  union all select doc_id, 'Operator', sent_idx from say{mark} where sale union all select doc_id, 'ThirdParty', sent_idx from say{mark} where sale
  union all select doc_id, 'RetentionClause', sent_idx from say{mark} where retain union all select doc_id, 'DurationIndefinite', sent_idx from say{mark} where endless union all select doc_id, 'DurationBounded', sent_idx from say{mark} where bounded),
edges{mark} as (
  select doc_id, 'DataSubject' as src_type, 'subjectOf' as edge_type, 'ConsentProcess' as tgt_type, bb_idx as sent_idx from g{mark} where bb union all select doc_id, 'ConsentProcess', 'grants', 'DataProcessing', bb_idx from g{mark} where bb
  union all select doc_id, 'ConsentProcess', 'requires', 'ParentalConsent', sent_idx from say{mark} where parental union all select doc_id, 'ConsentProcess', 'permits', 'Withdrawal', sent_idx from say{mark} where withdraw
  union all select doc_id, 'Operator', 'sellsTo', 'ThirdParty', sent_idx from say{mark} where sale
  union all select doc_id, 'RetentionClause', 'hasDuration', 'DurationIndefinite', sent_idx from say{mark} where endless union all select doc_id, 'RetentionClause', 'hasDuration', 'DurationBounded', sent_idx from say{mark} where bounded),
fired{mark} as materialized (
  select *, (age < 16 and jurisdiction = 'EU' and bb and not pc)::int as f_pc, (jurisdiction = 'EU' and bb and not wd)::int as f_wd,
    case when age < 16 and jurisdiction in ('EU', 'US') then sale else 0 end as f_sale, case when jurisdiction = 'EU' then ind else 0 end as f_ret, case when jurisdiction = 'EU' then ind + bnd else 0 end as f_notify
  from g{mark})"""


#: The same workload for the oracle.
SQL = f"""
notices as materialized (
  select doc_id, concat_ws(' ', {', '.join(_PICKS[::2])}, text, {', '.join(_PICKS[1::2])}) as text,
    ([{', '.join(str(a) for a, _ in GRID)}])[(doc_id % 9 + 1)::int] as age, ([{', '.join(_quoted(j) for _, j in GRID)}])[(doc_id % 9 + 1)::int] as jurisdiction
  from documents where doc_id is not null),{chain("notices")}
"""
