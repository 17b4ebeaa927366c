"""The registered queries as SQL over the driver's tables, for comparison in DuckDB."""

from __future__ import annotations

import re

from wayfare.plans.catalog import TODAY

_START = "timestamp '2024-01-01 00:00:00'"

# The stand-in tables. A query gets the ones it names, directly or through another one.
_VIEWS = {
    "class": """select * from (values (1,'Economy',0.00::decimal(19,2)),(2,'Economy Comfort',59.00),
        (3,'Business',99.00),(4,'First',199.00)) t(id,display_name,fee)""",
    "airport": """select 'N'||lpad(cast(n_nationkey as varchar),2,'0') iata, n_name as name,
        cast(25+(n_nationkey*7)%40 as double) lat, cast(-70-(n_nationkey*13)%60 as double) long from nation""",
    "airline": "select 'R'||cast(r_regionkey as varchar) callsign, r_name as name from region",
    "schedule": """select p_partkey id, 'R'||cast(p_partkey%5 as varchar) airline,
        cast(p_partkey%9000+100 as int) number, date '2024-01-01'+cast(p_size as int) valid_from,
        date '2024-01-01'+cast(p_size as int)+cast(p_partkey%21 as int) valid_to,
        'N'||lpad(cast(p_partkey%25 as varchar),2,'0') departure_airport,
        'N'||lpad(cast((p_partkey*7+3)%27 as varchar),2,'0') arrival_airport,
        (p_partkey*37)%1440 departure_min, (p_partkey*37+45+(p_partkey*11)%300)%1440 arrival_min,
        lpad(bin(p_partkey%128),7,'0') day_mask,
        cast(45+(p_partkey*11)%300+case when p_partkey%10=0 then 800 else 0 end as int) duration from part""",
    "expanded": """select id*1048576+(d-date '0001-01-01') id, airline, number,
        cast(d as timestamp)+to_minutes(cast(departure_min as int)) departure_time,
        cast(d as timestamp)+to_days(case when arrival_min<departure_min then 1 else 0 end)
          +to_minutes(cast(arrival_min as int)) arrival_time,
        duration, departure_airport, arrival_airport
        from (select s.*, cast(valid_from+cast(k as int) as date) d
              from (select schedule.*, unnest(range(0, valid_to-valid_from)) k from schedule) s) x
        where substr(day_mask, cast(extract(dow from d) as int)+1, 1)='1'
          and departure_airport in (select iata from airport)
          and arrival_airport in (select iata from airport)""",
    "flight": f"""select o_orderkey id, 'R'||cast(o_orderkey%5 as varchar) airline,
        cast(o_orderkey%9000+100 as int) number,
        {_START}+to_minutes(cast((o_orderkey*7919)%43200 as int)) departure_time,
        {_START}+to_minutes(cast((o_orderkey*7919)%43200+60+(o_orderkey*31)%240 as int)) arrival_time,
        'N'||lpad(cast(o_custkey%25 as varchar),2,'0') departure_airport,
        'N'||lpad(cast((o_custkey%25+1+(o_orderkey//5)%24)%25 as varchar),2,'0') arrival_airport from orders""",
    "flight_cosine": """select f.id, sin(a.lat/57.2958::double)*sin(b.lat/57.2958::double)
        +cos(a.lat/57.2958::double)*cos(b.lat/57.2958::double)
        *cos(b.long/57.2958::double-a.long/57.2958::double) d
        from flight f join airport a on f.departure_airport=a.iata join airport b on f.arrival_airport=b.iata""",
    "flight_miles": """select id, case when d<>0 then 3958.75::double*atan(sqrt(greatest(0,1-power(d,2)))/d)
        else 0 end miles from flight_cosine""",
    "flight_class": """select id flight_id, class_id,
        case class_id when 1 then 48 when 2 then 8 when 3 then 8 when 4 then 4 end capacity,
        cast(cast(round(miles*0.032::double+230,12) as decimal(19,2))+fee as decimal(19,2)) price
        from flight_miles cross join (select id class_id, fee from class) c""",
    "offer": """select f.*, fc.class_id, fc.price from flight f join flight_class fc on fc.flight_id=f.id""",
    "request": f"""select c_custkey request_id, 'R'||cast(c_custkey%5 as varchar) airline,
        'N'||lpad(cast(c_nationkey as varchar),2,'0') origin,
        'N'||lpad(cast((c_nationkey+1+c_custkey%24)%25 as varchar),2,'0') destination,
        {_START}+to_days(cast(c_custkey%30 as int)) dmin,
        {_START}+to_days(cast(c_custkey%30+1 as int)) dmax,
        cast(1+c_custkey%4 as int) class_id, 3 max_legs from customer""",
    "form": """select c_custkey request_id, case when c_custkey%13<>0 then c_custkey end customer_id,
        case when c_custkey%6<>0 then 'R'||cast(c_custkey%5 as varchar) end airline,
        case when c_custkey%3<>0 then 'N'||lpad(cast(c_custkey%25 as varchar),2,'0') end from_airport,
        case when c_custkey%4<>0 then 'N'||lpad(cast((c_custkey+7)%25 as varchar),2,'0') end to_airport,
        case when c_custkey%19=0 then 'soon' when c_custkey%5<>0 then '1/'
          ||lpad(cast(1+c_custkey%30 as varchar),2,'0')||'/2024' end dep_date,
        case when c_custkey%7<>0 then cast(1+c_custkey%4 as varchar) end class_id,
        case when c_custkey%23=0 then 'any' when c_custkey%8<>0 then cast(c_custkey%9-2 as varchar) end max_legs
        from customer""",
    "resolved": f"""select request_id, coalesce(airline,'DL') airline,
        coalesce(from_airport, primary_airport_id, 'ORD') origin, coalesce(to_airport,'ATL') destination,
        cast(day as timestamp) dmin, cast(day+1 as timestamp) dmax, cabin class_id, 120 max_wait,
        greatest(0, least(legs, 3)) max_legs,
        case when day is null then 'departure date' when legs is null then 'number of legs'
          when cabin is null then 'class' end reason
        from (select f.*, a.primary_airport_id,
          case when dep_date is null then date '{TODAY}'
            else cast(try_strptime(dep_date, '%m/%d/%Y') as date) end as day,
          case when max_legs is null then 3 else try_cast(max_legs as int) end legs,
          case when f.class_id is null then 1 else try_cast(f.class_id as int) end cabin
          from form f left join account a on f.customer_id=a.id) x""",
    "cart_event": """select event_id seq, user_id customer_id,
        case event_type when 'click' then 'add' when 'view' then 'add' when 'error' then 'remove'
          when 'signup' then 'clear' else 'checkout' end as action,
        event_id%8 flight_id, cast(1+event_id%2 as int) class_id from events""",
    "carts_left": """select a.customer_id, a.seq, a.flight_id, a.class_id from cart_event a
        where a.action='add'
          and a.seq > coalesce((select max(c.seq) from cart_event c where c.customer_id=a.customer_id
            and c.action in ('clear','checkout')), -1)
          and a.seq > coalesce((select max(r.seq) from cart_event r where r.customer_id=a.customer_id
            and r.flight_id=a.flight_id and r.class_id=a.class_id and r.action='remove'), -1)""",
    "bought": """select e.seq cart_id, a.customer_id,
        row_number() over (partition by e.seq order by a.seq) seq, a.flight_id, a.class_id
        from cart_event a join cart_event e on e.customer_id=a.customer_id and e.action='checkout' and e.seq>a.seq
        where a.action='add' and not exists (select 1 from cart_event x where x.customer_id=a.customer_id
          and x.seq>a.seq and x.seq<e.seq and (x.action in ('clear','checkout') or x.action='remove'
            and x.flight_id=a.flight_id and x.class_id=a.class_id))""",
    "cart": """select l_orderkey cart_id, o_custkey customer_id,
        row_number() over (partition by l_orderkey
          order by l_linenumber,l_partkey,l_suppkey,l_extendedprice) seq,
        case when l_quantity>=49 then -1 else l_partkey end flight_id,
        cast(1+l_linenumber%4 as int) class_id, o_custkey paid_with
        from lineitem join orders on l_orderkey=o_orderkey""",
    "cart_cross": """select k.cart_id, fc.flight_id, fc.class_id, fc.price
        from (select distinct cart_id, flight_id from cart) k join flight_class fc on k.flight_id=fc.flight_id
        where exists (select 1 from cart c where c.cart_id=k.cart_id and c.class_id=fc.class_id)""",
    "cart_failed": """select distinct c.cart_id from cart c left join flight_class fc
        on c.flight_id=fc.flight_id and c.class_id=fc.class_id where fc.price is null""",
    "booked": """select c.cart_id*1048576+c.seq id, fc.price, cast(c.seq as int) leg, c.flight_id flight,
        c.customer_id, c.paid_with, c.class_id
        from cart c join flight_class fc on c.flight_id=fc.flight_id and c.class_id=fc.class_id
        where c.cart_id not in (select cart_id from cart_failed)""",
    "tag": """select o_orderkey cart_id, o_custkey customer_id,
        case when o_orderkey%31=0 then '[['||o_orderkey||']]' when o_orderkey%37=0 then 'none'
          else '[['||o_orderkey||', '||q||'], ['||(o_orderkey+1)||', '||q||']]' end tag
        from (select *, case when o_orderkey%9=0 then '"'||(1+o_orderkey%4)||'"'
          else cast(1+o_orderkey%4 as varchar) end q from orders) o""",
    "tag_row": """select cart_id, customer_id, s seq,
        cast(json_extract_string(tag, '$['||(s-1)||'][0]') as bigint) flight_id,
        cast(json_extract_string(tag, '$['||(s-1)||'][1]') as int) class_id
        from tag cross join (values (1::bigint),(2)) n(s)
        where cart_id%31<>0 and cart_id%37<>0""",
    "ticket": """select 4611686018427387904+l_orderkey*10+l_linenumber id,
        cast(round(max(l_extendedprice)/100,2) as decimal(19,2)) price, 0 leg, min(l_partkey) flight,
        min(o_custkey) customer_id, min(o_custkey) paid_with, cast(1+l_linenumber%4 as int) class_id
        from lineitem join orders on l_orderkey=o_orderkey group by l_orderkey, l_linenumber""",
    "address": """select c_custkey id, c_name||' St' line_1,
        case when c_custkey%3=0 then 'Suite '||cast(c_custkey%90 as varchar) else '' end line_2,
        c_mktsegment city,
        case when c_custkey%5=0 then null else 'P'||cast(c_custkey%10 as varchar) end province,
        lpad(cast(c_custkey as varchar),5,'0') postal_code, n_name country
        from customer join nation on c_nationkey=n_nationkey""",
    "account": """select c_custkey id, c_name as name, c_name||'@Example.com' email,
        case when c_custkey%7=0 then null else c_custkey end primary_payment_id, c_custkey primary_address_id,
        'N'||lpad(cast(c_nationkey as varchar),2,'0') primary_airport_id from customer""",
    "customer_address": """select c_custkey customer_id, c_custkey address_id from customer
        union all select c_custkey, (c_custkey+1)%(select count(*) from customer)
        from customer where c_custkey%2=0""",
    "payment_method": """select c_custkey id, c_custkey customer_id,
        make_date(2025+c_custkey%5, 1+c_custkey%12, 1) exp, c_name card_holder,
        'Visa '||lpad(cast(c_custkey%10000 as varchar),4,'0') display_name, c_custkey billing_address
        from customer""",
    "account_change": """select event_id seq, user_id customer_id,
        case event_type when 'view' then 'add_address' when 'error' then 'remove_address'
          when 'click' then 'set_primary_address' when 'purchase' then 'set_primary_payment'
          else 'add_payment' end as action,
        event_id%(select count(*) from customer) target_id from events""",
    "change_log": """select event_id seq, user_id customer_id,
        case event_type when 'view' then 'add_address' when 'error' then 'remove_address'
          when 'click' then 'add_payment' when 'purchase' then 'remove_payment'
          else 'set_primary_payment' end as action,
        user_id+case when event_id%3=0 then 0 else (select count(*) from customer) end target_id,
        'Dock '||cast(event_id%700 as varchar) line1,
        case when event_id%3<>0 then 'Floor '||cast(event_id%40 as varchar) else '' end line2,
        'P'||cast(event_id%10 as varchar) province, lpad(cast(event_id as varchar),5,'0') post,
        lpad(cast((event_id*7919)%10000000 as varchar),16,'0') card_number,
        case when event_id%17=0 then 0 else 2025+event_id%6 end exp_year, event_id%14 exp_month,
        'Holder '||cast(user_id as varchar) card_holder, user_id address_id from events""",
    "payment_form": """select event_id payment_id, user_id customer_id,
        lpad(cast((event_id*7919)%10000000 as varchar),16,'0') card_number,
        case when event_id%17=0 then 'soon' else cast(2025+event_id%6 as varchar) end exp_year,
        case when event_id%29=0 then 'x' else cast(event_id%14 as varchar) end exp_month,
        'Holder '||cast(user_id as varchar) card_holder,
        event_id%(select count(*) from customer) address_id from events where event_type='signup'""",
    "payment_removal": """select event_id seq, user_id customer_id,
        case when event_id%2=0 then user_id else event_id%(select count(*) from customer) end target_id
        from events where event_type='error'""",
    "registration": """select 1000000000+c_custkey customer_id, 2000000000+c_custkey address_id, c_name as name,
        lower(c_name)||'@example.org' email, 'Unit '||cast(c_custkey%500 as varchar) addr, c_mktsegment city,
        'P'||cast(c_custkey%10 as varchar) province, lpad(cast(c_custkey as varchar),5,'0') post,
        'N'||lpad(cast(c_nationkey as varchar),2,'0') country,
        'N'||lpad(cast(c_custkey%27 as varchar),2,'0') home from customer""",
    "address_form": """select c_custkey customer_id, 3000000000+c_custkey address_id,
        'Dock '||cast(c_custkey%700 as varchar) line1,
        case when c_custkey%3<>0 then 'Floor '||cast(c_custkey%40 as varchar) end line2, c_mktsegment city,
        'P'||cast(c_custkey%10 as varchar) province, lpad(cast(c_custkey as varchar),5,'0') post,
        'N'||lpad(cast(c_nationkey as varchar),2,'0') country from customer""",
    # Tables with faults for the integrity checks.
    "bad_customer": """select case when c_custkey%50=0 then abs(c_custkey-1) else c_custkey end id,
        case when c_custkey%41<>0 then c_name end as name,
        case when c_custkey%7<>0 then c_custkey end primary_payment_id, c_custkey primary_address_id,
        case when c_custkey%100=0 then 'N7' else 'N'||lpad(cast(c_custkey%27 as varchar),2,'0') end
          primary_airport_id from customer""",
    "bad_address": "select * from address where id%60<>0",
    "bad_airline": "select * from airline where callsign<>'R4'",
    "bad_class": """select id, fee from class
        union all select 9, cast(-1.00 as decimal(19,2)) from region where r_regionkey=0""",
    "bad_ticket": "select flight, customer_id, paid_with, case when id%500=0 then 7 else class_id end class_id from ticket",
    "bad_payment_method": "select id, customer_id, case when id%43<>0 then billing_address end billing_address from payment_method",
    "bad_flight_class": """select flight_id, class_id, case when flight_id%90<>0 then capacity end capacity
        from flight_class""",
}

_RECEIPT = """select t.id ticket_id, t.customer_id, fc.flight_id, fc.class_id, c.display_name class_name,
    f.airline, f.number, f.departure_airport, f.departure_time, f.arrival_airport, f.arrival_time, fc.price
    from {tickets} t join flight_class fc on t.flight=fc.flight_id and t.class_id=fc.class_id
    join flight f on fc.flight_id=f.id join class c on fc.class_id=c.id"""


def _paths(requests: str) -> str:
    """Recursive search for every row of ``requests``, and its itineraries as ``found``."""
    return f"""recursive walk as (
      select r.request_id, r.class_id, r.airline, r.destination, r.max_legs, [f.id] ids,
        [f.departure_airport] path, 1 leg, f.arrival_airport, f.arrival_time,
        cast(f.price as decimal(19,2)) price
      from {requests} r join offer f on f.airline=r.airline and f.departure_airport=r.origin
        and f.class_id=r.class_id and r.dmin<=f.departure_time and f.departure_time<=r.dmax
      union all
      select w.request_id, w.class_id, w.airline, w.destination, w.max_legs, list_append(w.ids, f.id),
        list_append(w.path, f.departure_airport), w.leg+1, f.arrival_airport, f.arrival_time,
        cast(w.price+f.price as decimal(19,2))
      from walk w join offer f on f.departure_airport=w.arrival_airport and f.airline=w.airline
        and f.class_id=w.class_id and w.arrival_time<f.departure_time
        and f.departure_time<=w.arrival_time+interval 2 hour
      where w.leg<w.max_legs and not list_contains(w.path, f.arrival_airport)),
    found as (select request_id, class_id, airline, ids, list_append(path, arrival_airport) path,
      leg total_legs, price total_price from walk where arrival_airport=destination),
    found_leg as (select g.request_id, g.class_id, g.ids, g.path, g.total_legs, g.total_price, g.leg,
        f.id, f.airline, f.number, f.departure_airport, f.departure_time, f.arrival_airport, f.arrival_time,
        f.price
      from (select found.*, unnest(ids) flight_id, cast(unnest(range(1, len(ids)+1)) as int) leg from found) g
      join offer f on f.id=g.flight_id and f.class_id=g.class_id)"""


_SHOWN = """select request_id, array_to_string(ids, ',') ids, array_to_string(path, ',') path, total_legs,
    total_price from found"""

_FLAT_LABEL = """coalesce(line_1,'')||' '||coalesce(line_2,'')||', '||coalesce(city,'')||', '
    ||coalesce(province,'')||' '||coalesce(postal_code,'')||'{sep}'||coalesce(country,'')"""


def _legs_view(legs: int) -> str:
    return f"asked as (select * replace ({legs} as max_legs) from request)"


def _pk(view: str, table: str, keys: str, rule: str = "primary key") -> str:
    text = "||','||".join(f"cast({k} as varchar)" for k in keys.split(","))
    return f"""select '{rule}' as rule, '{table}' as "table", {text} as key, count(*) violations
        from {view} group by {keys} having count(*)>1"""


def _nulls(view: str, table: str, column: str) -> str:
    return f"""select 'not null' as rule, '{table}' as "table", '{column}' as key, count(*) violations
        from {view} where {column} is null having count(*)>0"""


def _fk(child: str, table: str, column: str, parent: str, key: str) -> str:
    return f"""select 'foreign key' as rule, '{table}' as "table",
        '{column}='||cast({column} as varchar) as key, count(*) violations from {child}
        where {column} is not null and {column} not in (select {key} from {parent} where {key} is not null)
        group by {column}"""


def _rule(rule: str, view: str, table: str, key: str, broken: str) -> str:
    return f"""select '{rule}' as rule, '{table}' as "table", '{key}' as key, count(*) violations
        from {view} where {broken} having count(*)>0"""


_TWICE = """(select * from schedule union all select * replace (id+1000000000 as id) from schedule
    where id%97=0)"""

# name -> (extra WITH items, query)
_SQL: dict[str, tuple[str, str]] = {
    "airports": ("", "select iata, name, lat, long from airport"),
    "airlines": ("", "select callsign, name from airline"),
    "bit_position_lists": (
        "",
        """select id, nullif(concat_ws(',', case when substr(day_mask,1,1)='1' then '0' end,
            case when substr(day_mask,2,1)='1' then '1' end, case when substr(day_mask,3,1)='1' then '2' end,
            case when substr(day_mask,4,1)='1' then '3' end, case when substr(day_mask,5,1)='1' then '4' end,
            case when substr(day_mask,6,1)='1' then '5' end, case when substr(day_mask,7,1)='1' then '6' end),
            '') positions from schedule""",
    ),
    "schedule_expand": ("", "select * from expanded"),
    "schedule_duration_audit": (
        "",
        """select airline, number, departure_time, arrival_time, duration from expanded
            where abs(datediff('minute', departure_time, arrival_time)-duration)>720""",
    ),
    "great_circle": ("", "select id, round(miles, 6) miles from flight_miles"),
    "great_circle_exact": (
        "",
        "select id, round(3958.75::double*acos(greatest(-1.0, least(1.0, d))), 6) miles from flight_cosine",
    ),
    "fare_table": ("", "select flight_id, class_id, capacity, price from flight_class"),
    "fare_capacity": (
        "",
        """select class_id, capacity, count(*) fares, cast(sum(price) as decimal(19,2)) total
            from flight_class group by class_id, capacity""",
    ),
    "fare_refused": (
        "",
        """select id flight_id, 9 class_id,
            cast(cast(round(miles*0.032::double+230,12) as decimal(19,2))-1 as decimal(19,2)) price
            from flight_miles""",
    ),
    "search_requests": ("", "select * exclude (reason) from resolved where reason is null"),
    "search_requests_refused": ("", "select request_id, reason from resolved where reason is not null"),
    "search_forms": (
        "asked as (select * from resolved where reason is null), " + _paths("asked"),
        _SHOWN,
    ),
    "search_nonstop": (_legs_view(1) + ", " + _paths("asked"), _SHOWN),
    "search_one_stop": (_legs_view(2) + ", " + _paths("asked"), _SHOWN),
    "search_itineraries": (_paths("request"), _SHOWN),
    "search_stored": (_paths("request"), _SHOWN),
    "search_four_legs": (
        "asked as (select * replace (cast(1+request_id%4 as int) as max_legs) from request), " + _paths("asked"),
        _SHOWN,
    ),
    "search_reachable": (_paths("request"), _SHOWN),
    "search_shared": (
        """asked as (select * replace (cast(1+request_id%4 as int) as class_id, cast(1+request_id%4 as int) as max_legs)
            from request union all select * replace (request_id+1000000000 as request_id,
            cast(1+(request_id+1)%4 as int) as class_id) from request), """
        + _paths("asked"),
        _SHOWN,
    ),
    "search_legs": (
        _paths("request"),
        """select request_id, array_to_string(ids, ',') ids, id, array_to_string(path, ',') path, leg,
            total_legs, airline, number, departure_airport, departure_time, arrival_airport, arrival_time,
            price, total_price from found_leg""",
    ),
    "search_ranked": (
        _paths("request"),
        """select request_id, row_number() over (partition by request_id order by total_price, ids) as rank,
            array_to_string(ids, ',') ids, total_price from found""",
    ),
    "search_no_match": (
        _paths("request"),
        """select request_id, origin, destination from request
            where request_id not in (select request_id from found)""",
    ),
    "search_labels": (
        _paths("request"),
        """select request_id, leg, airline||cast(number as varchar) flight, array_to_string(path, ' → ') route,
            strftime(departure_time, '%I:%M %p') departs, strftime(arrival_time, '%I:%M %p') arrives
            from found_leg""",
    ),
    "booking_tags": (
        _paths("request"),
        """select request_id, '[['||replace(array_to_string(ids, ','), ',', ','||class_id||'],[')
            ||','||class_id||']]' tag from found""",
    ),
    "class_list": (
        "",
        "select id, display_name from class where id in (select class_id from flight_class) order by id",
    ),
    "cart_from_tags": ("", "select * from tag_row"),
    "cart_from_many_tags": (
        "",
        """select customer_id cart_id, customer_id,
            row_number() over (partition by customer_id order by cart_id, seq) seq, flight_id, class_id from tag_row""",
    ),
    "checkout_carts": ("", "select * from bought"),
    "checkout_tickets": (
        """failed as (select distinct b.cart_id from bought b left join flight_class fc
            on b.flight_id=fc.flight_id and b.class_id=fc.class_id where fc.price is null)""",
        """select b.cart_id*1048576+b.seq id, fc.price, cast(b.seq as int) leg, b.flight_id flight, b.customer_id,
            b.customer_id paid_with, b.class_id
            from bought b join flight_class fc on b.flight_id=fc.flight_id and b.class_id=fc.class_id
            where b.cart_id not in (select cart_id from failed)""",
    ),
    "cart_tags_refused": ("", "select cart_id, customer_id, tag from tag where cart_id%31=0 or cart_id%37=0"),
    "cart_state": ("", "select * from carts_left"),
    "cart_stream": ("", "select * from carts_left"),
    "cart_keyed_stream": ("", "select * from carts_left"),
    "cart_review": (
        "",
        """select k.cart_id, fc.flight_id, fc.class_id, c.display_name class_name, f.airline, f.number,
            f.departure_airport, f.departure_time, f.arrival_airport, f.arrival_time, fc.price
            from cart k join flight_class fc on k.flight_id=fc.flight_id and k.class_id=fc.class_id
            join flight f on fc.flight_id=f.id join class c on fc.class_id=c.id""",
    ),
    "cart_review_cross": (
        "",
        """select k.cart_id, k.flight_id, k.class_id, c.display_name class_name, f.airline, f.number,
            f.departure_airport, f.departure_time, f.arrival_airport, f.arrival_time, k.price
            from cart_cross k join flight f on k.flight_id=f.id join class c on k.class_id=c.id""",
    ),
    "cart_totals": (
        "",
        """select o_orderkey cart_id, case when o_orderkey in (select cart_id from cart) then total
            else 0.00 end::decimal(19,2) total
            from orders left join (select k.cart_id, cast(sum(fc.price) as decimal(19,2)) total
              from cart k join flight_class fc on k.flight_id=fc.flight_id and k.class_id=fc.class_id
              group by k.cart_id) s on o_orderkey=s.cart_id""",
    ),
    "cart_totals_cross": (
        "",
        """select k.cart_id, total from (select distinct cart_id from cart) k left join
            (select cart_id, cast(sum(price) as decimal(19,2)) total from cart_cross group by cart_id) s
            on k.cart_id=s.cart_id""",
    ),
    "cart_pair_audit": (
        "",
        """select x.cart_id, x.flight_id, x.class_id, x.price from cart_cross x where not exists
            (select 1 from cart c where c.cart_id=x.cart_id and c.flight_id=x.flight_id
              and c.class_id=x.class_id)""",
    ),
    "book_tickets": ("", "select * from booked"),
    "ticket_append": ("", "select * from booked"),
    "schedule_quarantined": (
        "",
        """select id, case when id%70=0 then 'broken' when id%50=0 then 'departure_min' else 'row' end outcome
            from schedule""",
    ),
    "timetable_build": (
        """cosine as (select f.id, sin(a.lat/57.2958::double)*sin(b.lat/57.2958::double)
              +cos(a.lat/57.2958::double)*cos(b.lat/57.2958::double)
              *cos(b.long/57.2958::double-a.long/57.2958::double) d
            from expanded f join airport a on f.departure_airport=a.iata join airport b on f.arrival_airport=b.iata),
          miles as (select id, case when d<>0 then 3958.75::double*atan(sqrt(greatest(0,1-power(d,2)))/d)
            else 0 end miles from cosine)""",
        """select m.id flight_id, c.id class_id, case c.id when 1 then 48 when 2 then 8 when 3 then 8 when 4 then 4 end capacity,
            cast(cast(round(miles*0.032::double+230,12) as decimal(19,2))+fee as decimal(19,2)) price
            from miles m cross join class c""",
    ),
    "allocated_keys": (
        "",
        """select customer_id, email, row_number() over (order by customer_id%2 desc, customer_id) id from registration""",
    ),
    "receipts_stored": ("", _RECEIPT.format(tickets="ticket")),
    "ticket_history_read": ("", _RECEIPT.format(tickets="ticket")),
    "integrity_incremental": (
        "",
        " union all ".join(
            [
                _pk("bad_customer", "customer", "id"),
                _pk("bad_address", "address", "id"),
                _pk("payment_method", "payment_method", "id"),
                _fk("bad_customer", "customer", "primary_payment_id", "payment_method", "id"),
                _fk("bad_customer", "customer", "primary_address_id", "bad_address", "id"),
                _fk("bad_payment_method", "payment_method", "billing_address", "bad_address", "id"),
                _fk("bad_payment_method", "payment_method", "customer_id", "bad_customer", "id"),
            ]
        ),
    ),
    "book_tickets_leg_zero": ("", "select * exclude (id) replace (0 as leg) from booked"),
    "book_refused": (
        "",
        """select c.cart_id, c.customer_id, c.seq, c.flight_id, c.class_id,
            case when fc.price is null then 'no price' end reason
            from cart c left join flight_class fc on c.flight_id=fc.flight_id and c.class_id=fc.class_id
            where c.cart_id in (select cart_id from cart_failed)""",
    ),
    "receipts": (
        "",
        """select r.*, strftime(departure_time, 'Departing at %H:%M on %m-%d-%y') departing from ("""
        + _RECEIPT.format(tickets="booked")
        + ") r",
    ),
    "receipt_totals": (
        "",
        "select customer_id, cast(sum(price) as decimal(19,2)) total from ("
        + _RECEIPT.format(tickets="booked")
        + ") r group by customer_id",
    ),
    "receipt_totals_cross": (
        "",
        """select cart_id, cast(sum(price) as decimal(19,2)) total from cart_cross
            where cart_id not in (select cart_id from cart_failed) group by cart_id""",
    ),
    "ticket_history": ("", _RECEIPT.format(tickets="ticket")),
    "booking_stream": (
        """tag_bad as (select distinct r.cart_id from tag_row r left join flight_class fc
            on r.flight_id=fc.flight_id and r.class_id=fc.class_id where fc.price is null)""",
        """select r.cart_id*1048576+r.seq id, fc.price, cast(r.seq as int) leg, r.flight_id flight,
            r.customer_id, r.customer_id paid_with, r.class_id
            from tag_row r join flight_class fc on r.flight_id=fc.flight_id and r.class_id=fc.class_id
            where r.cart_id not in (select cart_id from tag_bad)""",
    ),
    "customer_by_email": (
        "wanted as (select upper(c_name)||'@EXAMPLE.COM' email from customer)",
        """select w.email wanted_email, a.id, a.name from wanted w join account a
            on lower(w.email)=lower(a.email)""",
    ),
    "customer_by_email_pattern": (
        """wanted as (select upper(substr(c_name,1,length(c_name)-2)||'_'||right(c_name,1))||'@EXAMPLE.COM' email
            from customer)""",
        "select w.email wanted_email, a.id, a.name from wanted w join account a on a.email ilike w.email",
    ),
    "customer_by_email_part": (
        """wanted as (select '%'||right(c_name,5)||'@ex_mple%' email from customer
            union all select '%'||cast(r_regionkey as varchar)||'_@%' from region)""",
        "select w.email wanted_email, a.id, a.name from wanted w join account a on a.email ilike w.email",
    ),
    "duplicate_emails": (
        "",
        """select lower(email) email, count(*) customers from (select email from registration
            union all select email from registration where customer_id%3=0) r
            group by lower(email) having count(*)>1""",
    ),
    "primaries": ("", "select id, primary_payment_id, primary_address_id from account"),
    "payment_methods": (
        "",
        """select p.customer_id, p.id, p.display_name, p.id is not distinct from a.primary_payment_id is_primary
            from payment_method p join account a on p.customer_id=a.id""",
    ),
    "address_book": (
        "",
        """select ca.customer_id, ca.address_id id, line_1, line_2, city, province, postal_code, country,
            ca.address_id is not distinct from a.primary_address_id is_primary, """
        + _FLAT_LABEL.format(sep=" ")
        + """ as label from customer_address ca full outer join address d on ca.address_id=d.id
            join account a on ca.customer_id=a.id where ca.customer_id is not null""",
    ),
    "checkout_addresses": (
        "",
        """select ca.customer_id, ca.address_id, d.id address_key, line_1, line_2, city, province, postal_code,
            country, ca.address_id is not distinct from a.primary_address_id is_primary, """
        + _FLAT_LABEL.format(sep=", ")
        + """ as label from customer_address ca join account a on ca.customer_id=a.id
            left join address d on ca.address_id=d.id""",
    ),
    "apply_address_links": (
        """newest as (select customer_id, target_id address_id, arg_max(action, seq) as action
            from account_change where action in ('add_address','remove_address') group by 1, 2)""",
        """select customer_id, address_id from customer_address l where not exists (select 1 from newest n
              where n.customer_id=l.customer_id and n.address_id=l.address_id)
            union all select customer_id, address_id from newest where action='add_address'""",
    ),
    "apply_changes_address": (
        """newest as (select target_id id, max(seq) seq from change_log where action='add_address' group by 1)""",
        """select * from address where id not in (select id from newest)
            union all select c.target_id, c.line1, c.line2, 'City', c.province, c.post, 'Land'
            from newest n join change_log c on c.seq=n.seq""",
    ),
    "apply_changes_customer_address": (
        """newest as (select customer_id, target_id address_id, arg_max(action, seq) as action
            from change_log where action in ('add_address','remove_address') group by 1, 2)""",
        """select customer_id, address_id from customer_address l where not exists (select 1 from newest n
              where n.customer_id=l.customer_id and n.address_id=l.address_id)
            union all select customer_id, address_id from newest where action='add_address'""",
    ),
    "apply_changes_payment_method": (
        """usable as (select * from change_log where action='remove_payment'
            or action='add_payment' and exp_year>0 and exp_month between 1 and 12),
          newest as (select target_id id, customer_id, max(seq) seq from usable group by 1, 2)""",
        """select * from payment_method p where not exists (select 1 from newest n
              where n.id=p.id and n.customer_id=p.customer_id)
            union all select c.target_id, c.customer_id, make_date(exp_year, exp_month, 1), card_holder,
              'Visa '||substr(card_number,1,4), c.address_id
            from newest n join change_log c on c.seq=n.seq where c.action='add_payment'""",
    ),
    "apply_primaries": ("", ""),
    "account_stream": ("", ""),
    "onboard_addresses": (
        "",
        """select address_id id, addr line_1, '' line_2, city, province, post postal_code, country
            from registration where home in (select iata from airport)""",
    ),
    "onboard_customers": (
        "",
        """select customer_id id, name, email, address_id primary_address_id, home primary_airport_id
            from registration where home in (select iata from airport)""",
    ),
    "onboard_links": (
        "",
        "select customer_id, address_id from registration where home in (select iata from airport)",
    ),
    "onboard_refused": (
        "",
        "select customer_id, email, home from registration where home not in (select iata from airport)",
    ),
    "add_addresses": (
        "",
        """select address_id id, line1 line_1, coalesce(line2,'') line_2, city, province, post postal_code,
            country from address_form""",
    ),
    "add_address_links": (
        "",
        """select customer_id, address_id from customer_address
            union all select customer_id, address_id from address_form""",
    ),
    "add_payments": (
        "",
        """select payment_id id, customer_id, make_date(cast(exp_year as int), cast(exp_month as int), 1) exp,
            card_holder, 'Visa '||substr(card_number,1,4) display_name, address_id billing_address
            from payment_form where exp_year<>'soon' and exp_month not in ('x','0','13')""",
    ),
    "add_payments_refused": (
        "",
        """select payment_id, customer_id, case when exp_year='soon' then 'year is not a number'
            when exp_month='x' then 'month is not a number' else 'no such date' end reason
            from payment_form where exp_year='soon' or exp_month in ('x','0','13')""",
    ),
    "remove_payments": (
        "",
        """select * from payment_method p where not exists (select 1 from payment_removal r
            where r.target_id=p.id and r.customer_id=p.customer_id)""",
    ),
    "integrity_pk": (
        "",
        " union all ".join(
            [
                _pk("bad_customer", "customer", "id"),
                _pk("bad_address", "address", "id"),
                _pk("airport", "airport", "iata"),
                _pk("bad_airline", "airline", "callsign"),
                _pk("flight", "flight", "id"),
                _pk(_TWICE, "flight_schedule", "id"),
                _pk("bad_class", "class", "id"),
                _pk("payment_method", "payment_method", "id"),
                _pk("ticket", "ticket", "id"),
                _pk("bad_flight_class", "flight_class", "flight_id,class_id"),
                _pk("customer_address", "customer_address", "customer_id,address_id"),
            ]
        ),
    ),
    "integrity_nulls": (
        "",
        " union all ".join(
            [
                _nulls("bad_customer", "customer", "name"),
                _nulls("bad_customer", "customer", "primary_airport_id"),
                _nulls("bad_address", "address", "line_2"),
                _nulls("bad_payment_method", "payment_method", "billing_address"),
                _nulls("bad_flight_class", "flight_class", "capacity"),
            ]
        ),
    ),
    "integrity_fk": (
        "",
        " union all ".join(
            [
                _fk("bad_customer", "customer", "primary_payment_id", "payment_method", "id"),
                _fk("bad_customer", "customer", "primary_address_id", "bad_address", "id"),
                _fk("bad_customer", "customer", "primary_airport_id", "airport", "iata"),
                _fk("flight", "flight", "airline", "bad_airline", "callsign"),
                _fk("flight", "flight", "departure_airport", "airport", "iata"),
                _fk("flight", "flight", "arrival_airport", "airport", "iata"),
                _fk("bad_payment_method", "payment_method", "billing_address", "bad_address", "id"),
                _fk("bad_payment_method", "payment_method", "customer_id", "bad_customer", "id"),
                _fk("bad_ticket", "ticket", "flight", "flight", "id"),
                _fk("bad_ticket", "ticket", "customer_id", "bad_customer", "id"),
                _fk("bad_ticket", "ticket", "paid_with", "payment_method", "id"),
                _fk("bad_ticket", "ticket", "class_id", "bad_class", "id"),
                _fk("bad_flight_class", "flight_class", "flight_id", "flight", "id"),
                _fk("bad_flight_class", "flight_class", "class_id", "bad_class", "id"),
                _fk("customer_address", "customer_address", "customer_id", "bad_customer", "id"),
                _fk("customer_address", "customer_address", "address_id", "bad_address", "id"),
            ]
        ),
    ),
    "integrity_domain": (
        "",
        " union all ".join(
            [
                _rule("code length", "airport", "airport", "iata", "length(iata)<>3"),
                _rule("code length", "bad_customer", "customer", "primary_airport_id",
                      "length(primary_airport_id)<>3"),
                _rule("code length", "flight", "flight", "airline", "length(airline)<>2"),
                _rule("fee not negative", "bad_class", "class", "fee", "fee<0"),
                _pk(_TWICE, "flight_schedule",
                    "airline,number,valid_from,valid_to,departure_airport,departure_min,arrival_airport,arrival_min",
                    "unique timetable entry"),
            ]
        ),
    ),
}

_SQL["apply_primaries"] = _SQL["account_stream"] = (
    """newest_address as (select customer_id id, arg_max(target_id, seq) v from account_change
        where action='set_primary_address' group by 1),
      newest_payment as (select customer_id id, arg_max(target_id, seq) v from account_change
        where action='set_primary_payment' group by 1)""",
    """select a.id, a.name, a.email, coalesce(p.v, a.primary_payment_id) primary_payment_id,
        coalesce(d.v, a.primary_address_id) primary_address_id, a.primary_airport_id
        from account a left join newest_address d on a.id=d.id left join newest_payment p on a.id=p.id""",
)

_NAMES = re.compile(r"\b(?:from|join)\s+(" + "|".join(sorted(_VIEWS, key=len, reverse=True)) + r")\b")

_SQL |= {"book_empty_carts": _SQL["booking_stream"], "payment_methods_read": _SQL["payment_methods"]}
_SQL |= {
    f"account_stream_{table}": _SQL[f"apply_changes_{table}"]
    for table in ("address", "customer_address", "payment_method")
}


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in _NAMES.findall(sql):
        if name not in found:
            _needed(_VIEWS[name], found)
            found[name] = None


def oracle_sql() -> dict[str, str]:
    out = {}
    for query, (extra, body) in _SQL.items():
        found: dict[str, None] = {}
        _needed(f"{extra} {body}", found)
        recursive = "recursive " in extra
        # The recursive term reads its tables once per level, so they are worked out first.
        how = "as materialized" if recursive else "as"
        items = [f"{name} {how} ({_VIEWS[name]})" for name in found]
        if extra:
            items.append(extra.replace("recursive ", ""))
        keyword = "with recursive" if recursive else "with"
        out[query] = f"{keyword} {', '.join(items)} {body}"
    return out
