"""The same queries as plain SQL over the raw tables, for a check by another engine.

The customer table is written here in another way than in the Spark plan:
sessions by a window over all events, the favourite category by a ranking.
"""

from __future__ import annotations

from custspark.schema import CATEGORICALS, DEFAULTS, DOMAINS, FEATURES, RANGES

CUSTOMERS = """
with o as (
  select o_custkey ck, count(*) n, sum(cast(o_totalprice as decimal(18,2))) s,
    min(cast(o_orderdate as date)) fd, max(cast(o_orderdate as date)) ld
  from orders group by o_custkey),
li as (
  select o_custkey ck, sum(case when l_returnflag = 'R' then 1 else 0 end) r,
    sum(case when l_returnflag <> 'R'
      then cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))
      else cast(0 as decimal(18,2)) end) clv
  from lineitem join orders on l_orderkey = o_orderkey group by o_custkey),
cat as (
  select ck, p_type from (
    select o_custkey ck, p_type,
      row_number() over (partition by o_custkey order by sum(l_quantity) desc, p_type) rn
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
    group by o_custkey, p_type) q
  where rn = 1),
e1 as (
  select user_id ck, event_id, date_trunc('second', ts) ts,
    lag(date_trunc('second', ts)) over (partition by user_id order by ts, event_id) p
  from events),
e2 as (
  select *, sum(case when p is null or datediff('second', p, ts) > 21600 then 1 else 0 end)
    over (partition by ck order by ts, event_id rows between unbounded preceding and current row) sid
  from e1),
se as (
  select ck, count(*) sc, cast(floor(avg(d)) as bigint) ad
  from (select ck, sid, datediff('second', min(ts), max(ts)) d from e2 group by ck, sid) z group by ck),
ev as (
  select user_id ck, count(*) n, sum(case when event_type = 'error' then 1 else 0 end) er,
    sum(case when event_type = 'click' then 1 else 0 end) cl,
    sum(case when event_type = 'purchase' then 1 else 0 end) pu,
    sum(case when event_type = 'view' then 1 else 0 end) vi
  from events group by user_id),
b as (
  select c.c_custkey, c.c_name, n.n_name, coalesce(o.n, 0) n, coalesce(cast(o.s as double), 0.0) s, o.fd,
    coalesce(datediff('day', o.ld, date '2001-08-02'), 9999) idle,
    coalesce(li.r, 0) r, coalesce(cast(li.clv as double), 0.0) clv, cat.p_type,
    coalesce(se.sc, 0) sc, coalesce(se.ad, 0) ad, coalesce(ev.er, 0) er, ev.cl, ev.pu, ev.vi, ev.n en
  from customer c left join nation n on c_nationkey = n_nationkey
    left join o on o.ck = c_custkey left join li on li.ck = c_custkey left join cat on cat.ck = c_custkey
    left join se on se.ck = c_custkey left join ev on ev.ck = c_custkey)
select c_name customer_id,
  case when s >= 3500000 then 'High-Value Loyal' when idle > 365 then 'At-Risk'
    when n >= 10 then 'Regular' else 'Occasional' end segment,
  cast(fd as varchar) registration_date,
  cast(coalesce(datediff('day', fd, date '2001-08-02'), 0) as bigint) days_since_registration,
  cast(18 + (c_custkey * 7) % 63 as bigint) age,
  case c_custkey % 3 when 0 then 'M' when 1 then 'F' else 'Other' end gender,
  n_name city,
  cast(n as bigint) purchase_frequency,
  case when n > 0 then s / n else 0.0 end avg_purchase_value,
  s total_spent,
  cast(idle as bigint) last_purchase_days,
  p_type favorite_category,
  case c_custkey % 2 when 0 then 'Website' else 'Mobile App' end preferred_channel,
  case when c_custkey % 5 < 2 then 'Mobile' when c_custkey % 5 < 4 then 'Desktop' else 'Tablet' end device_type,
  cast(sc as bigint) session_count,
  cast(ad as bigint) avg_session_duration,
  case when cl + pu > 0 then cast(cl as double) / (cl + pu) else 0.0 end cart_abandonment_rate,
  case when en > 0 then cast(vi as double) / en else 0.0 end email_open_rate,
  case when cl + vi > 0 then cast(cl as double) / (cl + vi) else 0.0 end click_through_rate,
  clv customer_lifetime_value,
  least(1.0, cast(idle as double) / 730) churn_probability,
  cast((c_custkey * 37) % 201 - 100 as bigint) nps_score,
  cast(er as bigint) support_tickets,
  cast(r as bigint) returns_count
from b
"""


def _over_customers(select: str, *ctes: str) -> str:
    return ",\n".join([f"with customers as ({CUSTOMERS})", *ctes]) + "\n" + select


def _rank(column: str) -> str:
    return f"dense_rank() over (order by coalesce({column}, 'nan')) - 1"


_SCORES = """
    1.0 / (last_purchase_days + 1) recency_score,
    ln(1 + cast(purchase_frequency as double)) frequency_score,
    ln(1 + total_spent) monetary_score,
    cast(session_count as double) * avg_session_duration / 1000.0 engagement_score,
    email_open_rate * click_through_rate email_engagement"""

_FEATURES = (
    "features as (select *, "
    + ", ".join(f"{_rank(c)} {c}_encoded" for c in CATEGORICALS)
    + f", {_SCORES} from customers)"
)


def _encoded(ctes: list[str], lookup: str) -> str:
    """Ranks of the labels that ``lookup`` gives for each column, -1 for others."""
    ranked = "select label, row_number() over (order by label) - 1 idx from"
    labels = [f"l_{c} as ({ranked} ({lookup.format(c)}))" for c in CATEGORICALS]
    joins = " ".join(f"left join l_{c} on l_{c}.label = coalesce({c}, 'nan')" for c in CATEGORICALS)
    columns = ", ".join(f"coalesce(l_{c}.idx, -1) {c}_encoded" for c in CATEGORICALS)
    return _over_customers(f"select customer_id, {columns} from customers {joins}", *ctes, *labels)


def _histogram() -> str:
    return _over_customers(
        """select b.bin, round(lo + b.bin * w, 4) bin_start, round(lo + (b.bin + 1) * w, 4) bin_end, count(c.bin) n_customers
        from bounds, (select unnest(range(50)) bin) b
          left join (select cast(least(floor((total_spent - lo) / w), 49) as bigint) bin from customers, bounds) c
          on b.bin = c.bin
        group by b.bin, lo, w""",
        """bounds as (select min(total_spent) lo,
          case when max(total_spent) = min(total_spent) then 1.0
            else (max(total_spent) - min(total_spent)) / 50.0 end w from customers)""",
    )


def _histogram_round() -> str:
    return _over_customers(
        """select b.bin, round(st + b.bin * w, 4) bin_start, round(st + (b.bin + 1) * w, 4) bin_end, count(c.bin) n_customers
        from placed, (select unnest(range(cast(floor((max(total_spent) - min(st)) / min(w)) as bigint) + 1)) bin
            from customers, placed) b
          left join (select cast(floor((total_spent - st) / w) as bigint) bin from customers, placed) c on b.bin = c.bin
        group by b.bin, st, w""",
        "bounds as (select min(total_spent) lo, (max(total_spent) - min(total_spent)) / 50.0 raw from customers)",
        "powers as (select lo, raw, pow(10.0, floor(log10(raw))) p from bounds)",
        """widths as (select lo, case when raw / p <= 2 then 2 * p when raw / p <= 5 then 5 * p else 10 * p end w
          from powers)""",
        "placed as (select w, floor(lo / w) * w st from widths)",
    )


def _rounded_features(digits: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {digits[c]}) {c}" if c in digits else f"{c}" for c in FEATURES)


def _standardize() -> str:
    columns = ", ".join(
        f"round(({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1.0 "
        f"else stddev_pop({c}) over () end, 6) {c}"
        for c in FEATURES
    )
    return _over_customers(f"select customer_id, {columns} from features", _FEATURES)


def _assembled() -> str:
    parts = [
        f"select customer_id, {i} as position, round(cast({c} as double), 6) as value from features"
        for i, c in enumerate(FEATURES)
    ]
    return _over_customers(" union all ".join(parts), _FEATURES)


def _violations(domains: dict = DOMAINS, source: str = "customers", select: str | None = None) -> str:
    rules = []
    for c, (low, high) in RANGES.items():
        if low is not None:
            rules.append(f"case when {c} < {low} then '{c}_below_{low}' end")
        if high is not None:
            rules.append(f"case when {c} > {high} then '{c}_above_{high}' end")
    for c, allowed in domains.items():
        texts = ", ".join(f"'{v}'" for v in allowed)
        rules.append(f"case when {c} not in ({texts}) then '{c}_unknown' end")
    return _over_customers(
        select or "select customer_id, violations, violations = '' as is_valid from checked",
        f"checked as (select customer_id, concat_ws(',', {', '.join(rules)}) violations from {source})",
    )


_GAPS = """(select segment, purchase_frequency,
    case age % 5 when 0 then null when 1 then null when 2 then 0.3 when 3 then 0.5
      else churn_probability end::double as churn_probability,
    case age % 5 when 1 then null when 2 then null else customer_lifetime_value end as customer_lifetime_value
  from customers)"""
_ODD_RATES = """(select * replace (case age % 5 when 0 then null when 1 then null when 2 then 1.2 when 3 then 1.0
    else email_open_rate end as email_open_rate) from customers)"""


def _defaults() -> str:
    unknown = [
        "session_count",
        "avg_session_duration",
        "email_open_rate",
        "click_through_rate",
        "cart_abandonment_rate",
        "support_tickets",
    ]
    columns = [
        f"case when session_count > 0 then {c} else {v} end {c}" if c in unknown else f"coalesce({c}, {v}) {c}"
        for c, v in DEFAULTS.items()
    ]
    return _over_customers(f"select customer_id, {', '.join(columns)} from customers")


_SIDE = "cast('0x' || substr(md5('42|' || customer_id), 1, 8) as bigint) % 100 < 80"

_R2 = "1 - sum(({0} - ({1})) * ({0} - ({1}))) / (var_pop({0}) * count(*))"
_MAE = "avg(abs({0} - ({1})))"
_CLV = ("customer_lifetime_value", "total_spent * 0.4::double")
_FREQUENCY = ("purchase_frequency", "total_spent / 250000.0")



def _exact_mean(column: str, bits: int) -> str:
    """A mean from whole numbers: the column's values are multiples of 2^-bits."""
    return f"cast(cast(sum(cast({column} * pow(2.0, {bits}) as hugeint)) as varchar) as double) / pow(2.0, {bits}) / count(*)"


_CLV_MEAN, _CHURN_MEAN = _exact_mean("customer_lifetime_value", 50), _exact_mean("churn_probability", 64)



def _level(depth: int) -> list[str]:
    """From each customer's node in the four trees to the node one level below.

    The best cut has the least squares left around the means of its two sides. For classes, whose targets are
    one column of 0 and 1 each, that is the Gini impurity. Cuts that are equally good go by feature, then by value.
    """
    return [
        f"""sums{depth} as (
          select model, k, node, position, value, count(*) n, sum(y) s
          from node{depth} join target using (customer_id, model) join entry using (customer_id)
          where is_train group by all)""",
        f"""sides{depth} as (
          select *, sum(n) over below nl, sum(s) over below sl, sum(n) over whole nt, sum(s) over whole st,
            (value + lead(value) over below) / 2 cut
          from sums{depth}
          window whole as (partition by model, k, node, position), below as (whole order by value))""",
        f"""cuts{depth} as (
          select model, node, position, cut, sum(sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) gain, sum(st * st / nt) base
          from sides{depth} where cut is not null group by all)""",
        f"""best{depth} as (
          select * from (select *, max(gain) over (partition by model, node) top from cuts{depth})
          where top > base * (1 + 1e-12)
          qualify row_number() over (partition by model, node order by round(gain / top, 12) desc, position, cut) = 1)""",
        f"""node{depth + 1} as (
          select n.customer_id, n.is_train, n.model,
            case when b.node is null then n.node else n.node * 2 + cast(e.value > b.cut as int) end node
          from node{depth} n left join best{depth} b on b.model = n.model and b.node = n.node
            left join entry e on e.customer_id = n.customer_id and e.position = b.position)""",
    ]


def _trees(select: str, depth: int = 3) -> str:
    """Four trees grown in SQL; ``predicted`` has each customer's features, labels and predictions."""
    entries = [f"select customer_id, {i} position, cast({c} as double) as value from features" for i, c in enumerate(FEATURES)]
    ctes = [
        _FEATURES,
        f"entry as ({' union all '.join(entries)})",
        "names as (select segment, row_number() over (order by segment) - 1 k from (select distinct segment from customers))",
        """target as (
          select customer_id, 'churn' model, 0 k, cast(churn_probability > 0.5 as int)::double y from customers
          union all select customer_id, 'clv', 0, customer_lifetime_value from customers
          union all select customer_id, 'frequency', 0, purchase_frequency::double from customers
          union all select customer_id, 'segment', k, cast(c.segment = names.segment as int)::double from customers c, names)""",
        f"""node0 as (select customer_id, {_SIDE} is_train, model, 1 node
          from customers, (values ('churn'), ('clv'), ('frequency'), ('segment')) m(model))""",
    ]
    for level in range(depth):
        ctes += _level(level)
    ctes += [
        f"""leaf as (select model, k, node, avg(y) y from node{depth} join target using (customer_id, model)
          where is_train group by all)""",
        f"""met as (select customer_id, is_train, model, k, y from node{depth} join leaf using (model, node))""",
        """guess as (
          select customer_id, is_train, max(y) filter (model = 'churn') p, max(y) filter (model = 'clv') clv,
            max(y) filter (model = 'frequency') frequency,
            arg_min(k, (-y, k)) filter (model = 'segment') k
          from met group by customer_id, is_train)""",
        """predicted as (
          select f.*, is_train, p, clv, frequency, names.segment guessed
          from features f join guess using (customer_id) join names using (k))""",
    ]
    return _over_customers(select, *ctes)


_TREE_METRICS = " union all ".join(
    f"select '{model}' as model, '{metric}' as metric, round({value}, {digits}) as value from predicted where not is_train"
    for model, metric, value, digits in (
        ("churn", "accuracy", "avg(((churn_probability > 0.5) = (p > 0.5))::int)", 6),
        ("clv", "r2", _R2.format("customer_lifetime_value", "clv"), 6),
        ("clv", "mae", _MAE.format("customer_lifetime_value", "clv"), 2),
        ("frequency", "r2", _R2.format("purchase_frequency", "frequency"), 6),
        ("frequency", "mae", _MAE.format("purchase_frequency", "frequency"), 2),
        ("segment", "accuracy", "avg((segment = guessed)::int)", 6),
    )
)

ORACLE: dict[str, str] = {
    "customer_table": _over_customers("select * from customers"),
    "scan_csv": _over_customers("select * from customers"),
    "scan_csv_quoted": _over_customers(
        """select * replace (
          case age % 5 when 0 then city || chr(10) || '"' || gender || '",' || chr(10) || segment
            when 1 then 'a' || chr(10) || ',"' || chr(10) || '"' || city else city end as city,
          case age % 5 when 1 then preferred_channel || '"' || chr(10) || chr(10) || 'x' when 2 then '5" "'
            else preferred_channel end as preferred_channel) from customers"""
    ),
    "table_roundtrip": _over_customers("select * from customers"),
    "key_check": _over_customers(
        """select cast(sum(n) as bigint) n_rows, count(customer_id) n_keys,
          cast(coalesce(sum(n) filter (customer_id is null), 0) as bigint) n_missing_keys,
          count(*) filter (customer_id is not null and n > 1) n_duplicate_keys
        from (select customer_id, count(*) n from customers group by customer_id)"""
    ),
    "feature_projection": _over_customers(
        "select "
        + _rounded_features(
            {
                "recency_score": 9,
                "frequency_score": 9,
                "monetary_score": 9,
                "engagement_score": 9,
                "email_engagement": 9,
            }
        )
        + " from features",
        _FEATURES,
    ),
    "kpi_high_value": _over_customers(
        "select count(*) high_value_customers from customers where segment = 'High-Value Loyal'"
    ),
    "kpi_at_risk": _over_customers("select count(*) at_risk_customers from customers where churn_probability > 0.5"),
    "churn_label": _over_customers(
        "select customer_id, case when churn_probability > 0.5 then 1 else 0 end churn_label from customers"
    ),
    "freq_vs_clv": _over_customers(
        "select customer_id, segment, purchase_frequency, customer_lifetime_value from customers"
    ),
    "rfm_scores": _over_customers(
        """select customer_id, round(recency_score, 9) recency_score, round(frequency_score, 9) frequency_score,
          round(monetary_score, 9) monetary_score from features""",
        _FEATURES,
    ),
    "engagement": _over_customers(
        """select customer_id, round(engagement_score, 9) engagement_score,
          round(email_engagement, 9) email_engagement from features""",
        _FEATURES,
    ),
    "retention_priority": _over_customers(
        """select customer_id, case when churn_probability > 0.5 then 'HIGH'
          when churn_probability > 0.3 then 'MEDIUM' else 'LOW' end retention_priority from customers"""
    ),
    "health_score": _over_customers(
        """select customer_id, round(((1 - churn_probability) * 0.4::double
          + email_engagement / (max(email_engagement) over () + 0.01::double) * 0.3::double
          + (nps_score + 100) / 200.0::double * 0.3::double) * 100, 6) customer_health_score from features""",
        _FEATURES,
    ),
    "kpi_summary": _over_customers(
        """select count(*) total_customers, 24::bigint total_columns,
          round(avg(customer_lifetime_value), 4) avg_lifetime_value,
          round(avg(churn_probability) * 100, 4) avg_churn_percent,
          count(*) filter (segment = 'High-Value Loyal') high_value_customers,
          count(*) filter (churn_probability > 0.5) at_risk_customers,
          round(avg(purchase_frequency), 4) avg_purchase_frequency from customers"""
    ),
    "clv_by_segment": _over_customers(
        """select segment, round(avg(customer_lifetime_value), 4) avg_lifetime_value
        from customers where segment is not null group by segment"""
    ),
    "churn_by_segment": _over_customers(
        """select segment, round(avg(churn_probability), 9) avg_churn_probability
        from customers where segment is not null group by segment"""
    ),
    "segment_distribution": _over_customers(
        """select segment, count(*) n_customers, round(count(*) / sum(count(*)) over (), 9) share
        from customers where segment is not null group by segment"""
    ),
    "churn_bands": _over_customers(
        """select case when churn_probability > 0.5 then 'High Risk' when churn_probability > 0.3
          then 'Medium Risk' else 'Low Risk' end risk_band, count(*) n_customers from customers group by 1"""
    ),
    "spend_histogram": _histogram(),
    "spend_histogram_round": _histogram_round(),
    "preview": _over_customers("select * from customers order by customer_id limit 10"),
    "label_encode": _encoded([], "select distinct coalesce({0}, 'nan') label from customers"),
    "label_encode_unseen": _encoded(
        [], "select distinct coalesce({0}, 'nan') label from customers where city < 'NATION_5'"
    ),
    "label_encode_large": _over_customers(
        f"select customer_id, {_rank('customer_id')} customer_id_encoded from customers"
    ),
    "segment_encode": _over_customers(
        "select customer_id, dense_rank() over (order by segment) - 1 segment_label from customers"
    ),
    "segment_labels_large": _over_customers(
        "select customer_id, dense_rank() over (order by customer_id) - 1 segment_label, customer_id original from customers"
    ),
    "segment_decode": _over_customers("select customer_id, segment from customers"),
    "standardize": _standardize(),
    "assembled_features": _assembled(),
    "split_rows": _over_customers(f"select customer_id, {_SIDE} is_train from customers"),
    "split_counts": _over_customers(
        f"select {_SIDE} is_train, segment, count(*) n_customers from customers group by 1, 2"
    ),
    "eval_accuracy": _over_customers(
        """select 'churn' as model, 'accuracy' as metric, round(avg(case when
          (churn_probability > 0.5) = (purchase_frequency < 9) then 1.0 else 0.0 end), 9) as value from customers
        union all select 'segment', 'accuracy', round(avg(case when
          (segment = 'High-Value Loyal') = (total_spent > 3000000) then 1.0 else 0.0 end), 9) from customers"""
    ),
    "eval_regression": _over_customers(
        " union all ".join(
            f"select '{model}' as model, '{metric}' as metric, round({text.format(*pair)}, 6) as value from customers"
            for model, pair in (("clv", _CLV), ("frequency", _FREQUENCY))
            for metric, text in (("r2", _R2), ("mae", _MAE))
        )
    ),
    "validate_inputs": _violations(),
    "validate_missing": _violations({"gender": ["M", "F"]}, _ODD_RATES),
    "rejected_rows": _violations(
        {"gender": ["M", "F"]}, _ODD_RATES, "select customer_id, violations from checked where violations <> ''"
    ),
    "quality_flags": _over_customers(
        """select customer_id, concat_ws(',',
          case when age % 5 = 0 or (age % 5 <> 1 and last_purchase_days = -1) then 'recency_undefined' end,
          case when purchase_frequency <= -1 then 'frequency_undefined' end,
          case when age % 5 in (0, 2) or total_spent <= -1 then 'monetary_undefined' end) score_flags from customers"""
    ),
    "duplicate_keys": _over_customers(
        "select customer_id, 2::bigint n_rows from customers where age % 5 = 0"
    ),
    "scan_csv_fractions": _over_customers(
        """select customer_id, age::double age, session_count::double session_count,
          avg_session_duration + 0.5::double avg_session_duration from customers"""
    ),
    "health_score_fixed_max": _over_customers(
        """select customer_id, round(((1 - churn_probability) * 0.4::double
          + email_engagement / (0.5::double + 0.01::double) * 0.3::double
          + (nps_score + 100) / 200.0::double * 0.3::double) * 100, 6) customer_health_score from features""",
        _FEATURES,
    ),
    "kpi_summary_missing": _over_customers(
        f"""select count(*) total_customers, 24::bigint total_columns,
          round(avg(customer_lifetime_value), 4) avg_lifetime_value,
          round(avg(churn_probability) * 100, 4) avg_churn_percent,
          count(*) filter (segment = 'High-Value Loyal') high_value_customers,
          count(*) filter (churn_probability > 0.5) at_risk_customers,
          round(avg(purchase_frequency), 4) avg_purchase_frequency from {_GAPS}"""
    ),
    "means_missing": _over_customers(
        f"""select segment, round(avg(churn_probability), 9) avg_churn_probability,
          round(avg(customer_lifetime_value), 4) avg_lifetime_value
        from {_GAPS} where segment is not null group by segment"""
    ),
    "split_exact": _over_customers(
        """select customer_id, rank() over (order by md5('42|' || customer_id)) > (count(*) over () * 20 + 99) // 100 is_train
        from customers"""
    ),
    "freq_vs_clv_sample": _over_customers(
        """select customer_id, segment, purchase_frequency, customer_lifetime_value, n / least(n, 100)::double weight
        from (select *, row_number() over (partition by segment order by md5('42|' || customer_id)) place,
          count(*) over (partition by segment) n from customers) where place <= 100"""
    ),
    "kpi_summary_exact": _over_customers(
        f"""select count(*) total_customers, 24::bigint total_columns, {_CLV_MEAN} avg_lifetime_value,
          {_CHURN_MEAN} * 100 avg_churn_percent,
          count(*) filter (segment = 'High-Value Loyal') high_value_customers,
          count(*) filter (churn_probability > 0.5) at_risk_customers,
          sum(purchase_frequency)::double / count(*) avg_purchase_frequency from customers"""
    ),
    "means_exact": _over_customers(
        f"""select segment, {_CHURN_MEAN} avg_churn_probability, {_CLV_MEAN} avg_lifetime_value
        from customers where segment is not null group by segment"""
    ),
    "scan_csv_inferred": _over_customers(
        """select customer_id, age, age * 3 a_whole, age / 4.0::double a_fraction, age % 2 = 0 a_flag,
          case when age % 5 <> 0 then age::double end a_gap,
          case when age = 74 then 'seventy-four' else age::varchar end a_late, null::double a_nothing from customers"""
    ),
    "preview_file_order": _over_customers("select * from customers order by customer_id desc limit 10"),
    "table_replaced": _over_customers("select * from customers where age > 30"),
    "key_check_bucketed": _over_customers(
        """select count(*) n_rows, count(distinct customer_id) n_keys, 0::bigint n_missing_keys,
          0::bigint n_duplicate_keys from customers where age > 30"""
    ),
    "tree_metrics": _trees(_TREE_METRICS),
    "tree_scores": _trees(
        """select customer_id, round(p, 9) churn_probability, cast(p > 0.5 as int) will_churn,
          round(clv, 2) predicted_clv, round(frequency, 6) predicted_frequency, guessed predicted_segment,
          round(((1 - p) * 0.4::double + email_engagement / (max(email_engagement) over () + 0.01::double) * 0.3::double
            + (nps_score + 100) / 200.0::double * 0.3::double) * 100, 6) customer_health_score,
          case when p > 0.5 then 'HIGH' when p > 0.3 then 'MEDIUM' else 'LOW' end retention_priority from predicted"""
    ),
    "score_contract": _over_customers(
        """select customer_id, true probability_fits, true class_fits, true priority_fits, true health_fits,
          true clv_fits, true frequency_fits, true segment_fits from customers"""
    ),
    "train_floors": """select model, metric, true as beats_trivial from (values ('churn', 'accuracy'), ('clv', 'r2'),
        ('clv', 'mae'), ('frequency', 'r2'), ('frequency', 'mae'), ('segment', 'accuracy')) t(model, metric)""",
    "fill_defaults": _defaults(),
}
