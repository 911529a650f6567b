"""The registered queries written independently as plain SQL (DuckDB
dialect) over the given tables.  The binding of the marketplace tables is
repeated here as CTEs, so the check covers the bindings as well as the
operators.  Output column names equal the Spark queries' names."""

from __future__ import annotations

# ---- bindings as CTEs ----------------------------------------------------------
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (deps, sql)


_cte("cards", """
SELECT p_partkey AS id, p_name AS name, p_type AS type,
       p_type || ' Card' AS human_readable_card_type, lower(p_type) AS frame_type,
       concat_ws(' ', p_name, 'from', p_brand) AS description,
       CASE WHEN p_size % 3 = 0 THEN 'Dragon' WHEN p_size % 3 = 1 THEN 'Spellcaster'
            ELSE 'Warrior' END AS race,
       CAST(p_size * 100 AS INTEGER) AS atk,
       CAST(CASE WHEN p_size % 5 <> 0 THEN (50 - p_size) * 100 END AS INTEGER) AS def,
       p_size AS level,
       CASE WHEN p_size % 4 = 0 THEN 'DARK' WHEN p_size % 4 = 1 THEN 'LIGHT'
            WHEN p_size % 4 = 2 THEN 'EARTH' END AS attribute,
       p_brand AS archetype, 'card-' || CAST(p_partkey AS VARCHAR) AS ygoprodeck_url
FROM part""")

_cte("vendedores", """
SELECT s_suppkey AS vendedor_id, s_name AS nombres,
       'Nation' || CAST(s_nationkey AS VARCHAR) AS apellidos,
       'seller' || CAST(s_suppkey AS VARCHAR) || '@mail.test' AS correo,
       'hash' || CAST(s_suppkey AS VARCHAR) AS password_hash,
       CASE WHEN length(CAST(s_suppkey AS VARCHAR)) > 8 THEN CAST(s_suppkey AS VARCHAR) ELSE lpad(CAST(s_suppkey AS VARCHAR), 8, '0') END AS dni,
       CASE WHEN s_suppkey % 7 <> 3 THEN 'KID' || CAST(s_suppkey AS VARCHAR) END AS konami_id,
       CASE WHEN s_suppkey % 2 = 0 THEN '+51' || CAST(s_suppkey AS VARCHAR) END AS whatsapp,
       CASE WHEN s_suppkey % 3 = 0 THEN '@s' || CAST(s_suppkey AS VARCHAR) END AS instagram,
       CAST(NULL AS VARCHAR) AS facebook, CAST(NULL AS VARCHAR) AS otro,
       CAST(s_suppkey % 3 AS INTEGER) AS intentos_fallidos,
       CASE WHEN s_suppkey % 10 = 0 THEN TIMESTAMP '2024-01-01 06:00:00' END AS bloqueado_hasta,
       CAST(NULL AS TIMESTAMP) AS ultimo_login,
       TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST((s_suppkey * 37) % 1000 AS BIGINT)) AS created_at,
       CAST(NULL AS TIMESTAMP) AS updated_at,
       s_acctbal > 0 AS activo, s_suppkey % 4 = 0 AS email_verificado
FROM supplier""")

_cte("inv_lines", """
SELECT l_suppkey AS vendedor_id, l_partkey AS card_id,
       CASE WHEN l_quantity = 50 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS cantidad,
       CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN CAST(0 AS DECIMAL(12,2))
            ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS precio,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS condicion,
       CASE WHEN l_linestatus <> 'O' THEN l_linestatus END AS idioma,
       CASE WHEN l_linenumber % 3 <> 0 THEN 'ED' || CAST(l_linenumber AS VARCHAR) END AS edicion,
       CASE WHEN l_discount >= 0.05 THEN 'orden ' || CAST(l_orderkey AS VARCHAR) END AS notas,
       l_shipdate AS "at", l_orderkey, l_linenumber,
       row_number() OVER (PARTITION BY l_suppkey, l_partkey
                          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity,
                                   l_extendedprice, l_discount, l_tax, l_returnflag,
                                   l_linestatus) AS seq
FROM lineitem""")

# request defaults: cantidad || 1, precio || null, condicion || 'Near Mint', idioma || 'Inglés'
_cte("inv_req", """
SELECT vendedor_id, card_id, seq, "at",
       CAST(CASE WHEN cantidad IS NULL OR cantidad = 0 THEN 1 ELSE cantidad END AS BIGINT) AS cantidad,
       CASE WHEN precio = 0 THEN NULL ELSE precio END AS precio,
       COALESCE(NULLIF(condicion, ''), 'Near Mint') AS condicion,
       COALESCE(NULLIF(idioma, ''), 'Inglés') AS idioma,
       NULLIF(edicion, '') AS edicion, NULLIF(notas, '') AS notas
FROM inv_lines WHERE card_id IS NOT NULL AND card_id <> 0""", ("inv_lines",))

_FOLD = """
SELECT vendedor_id * 1000000000 + card_id AS inventario_id, vendedor_id, card_id,
       SUM(cantidad) AS cantidad,
       arg_max(precio, seq) FILTER (WHERE precio IS NOT NULL) AS precio,
       arg_max(condicion, seq) AS condicion, arg_max(idioma, seq) AS idioma,
       arg_max(edicion, seq) FILTER (WHERE edicion IS NOT NULL) AS edicion,
       arg_max(notas, seq) FILTER (WHERE notas IS NOT NULL) AS notas,
       arg_min("at", seq) AS created_at, arg_max("at", seq) AS updated_at
FROM inv_req {where} GROUP BY vendedor_id, card_id"""
_cte("inventario", _FOLD.format(where=""), ("inv_req",))
_cte("inv_base", _FOLD.format(where="""WHERE "at" < TIMESTAMP '1998-01-01 00:00:00'"""), ("inv_req",))
_cte("inv_new", """SELECT * FROM inv_req WHERE "at" >= TIMESTAMP '1998-01-01 00:00:00'""", ("inv_req",))

_cte("detail", """
SELECT i.inventario_id, i.vendedor_id, s.nombres || ' ' || s.apellidos AS vendedor_nombre,
       s.konami_id, s.whatsapp, s.instagram, i.card_id, c.name AS card_name, i.cantidad,
       i.precio, i.condicion, i.idioma, i.edicion, i.notas, i.created_at, i.updated_at
FROM inventario i JOIN cards c ON i.card_id = c.id JOIN vendedores s ON i.vendedor_id = s.vendedor_id
WHERE i.cantidad > 0 AND s.activo""", ("inventario", "cards", "vendedores"))

_cte("users_t", """
SELECT c_custkey AS id, c_name AS username, 'hash' || CAST(c_custkey AS VARCHAR) AS password_hash,
       'p' || CAST(c_custkey AS VARCHAR) || '@mail.test' AS email,
       CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 8 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS dni,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'vendedor' ELSE 'cliente' END AS user_type,
       c_acctbal > 0 AS is_active,
       TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
       CAST(NULL AS TIMESTAMP) AS updated_at
FROM customer""")

_cte("roles_t", """
SELECT DISTINCT o_custkey AS user_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'vendedor'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'admin' ELSE 'cliente' END AS role
FROM orders""")

_cte("user_regs", """
SELECT o_orderkey AS seq,
       CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'player' || CAST(o_orderkey % (SELECT greatest(1, count(*) * 1 // 3) FROM orders) AS VARCHAR) END AS username,
       substr('secretpassword', 1, CAST(o_orderkey % 12 AS INTEGER)) AS password,
       CASE WHEN o_orderkey % 10 = 0 THEN 'bad-email'
            WHEN o_orderkey % 10 = 1 THEN 'with space@mail.test'
            WHEN o_orderkey % 11 = 0 THEN 'p' || CAST(o_custkey AS VARCHAR) || '@mail.test'
            ELSE 'r' || CAST(o_orderkey % (SELECT greatest(1, count(*) * 4 // 3) FROM orders) AS VARCHAR) || '@mail.test' END AS email,
       CASE WHEN o_orderkey % 13 = 0 THEN CASE WHEN length(CAST(o_custkey AS VARCHAR)) > 8 THEN CAST(o_custkey AS VARCHAR) ELSE lpad(CAST(o_custkey AS VARCHAR), 8, '0') END
            ELSE 'R' || CAST(o_orderkey % (SELECT greatest(1, count(*) * 7 // 15) FROM orders) AS VARCHAR) END AS dni,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'vendedor' WHEN o_orderpriority = '2-HIGH' THEN 'cliente'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'admin' WHEN o_orderpriority = '5-LOW' THEN ''
       END AS user_type
FROM orders""")

_cte("user_regs_v", """
SELECT *, CASE
  WHEN username IS NULL OR username = '' OR password IS NULL OR password = ''
       OR email IS NULL OR email = '' OR dni IS NULL OR dni = '' THEN 'missing_fields'
  WHEN user_type IS NOT NULL AND user_type <> '' AND user_type NOT IN ('cliente', 'vendedor') THEN 'invalid_user_type'
  WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'invalid_email'
  WHEN length(password) < 6 THEN 'short_password' END AS error
FROM user_regs""", ("user_regs",))

_cte("seller_regs", """
SELECT c_custkey AS seq,
       CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS nombres,
       c_mktsegment AS apellidos,
       CASE WHEN c_custkey % 13 <> 0 THEN 'Seller' || CAST(c_custkey % (SELECT greatest(1, count(*) * 2 // 3) FROM customer) AS VARCHAR) || '@Mail.Test' END AS correo,
       substr('contrasena-segura', 1, CAST(c_custkey % 14 AS INTEGER)) AS password,
       CASE WHEN length(CAST(c_custkey % (SELECT greatest(1, count(*) * 4 // 5) FROM customer) AS VARCHAR)) > 8 THEN CAST(c_custkey % (SELECT greatest(1, count(*) * 4 // 5) FROM customer) AS VARCHAR) ELSE lpad(CAST(c_custkey % (SELECT greatest(1, count(*) * 4 // 5) FROM customer) AS VARCHAR), 8, '0') END AS dni,
       CASE WHEN c_nationkey % 4 <> 0 THEN 'KID' || CAST(c_custkey % (SELECT greatest(1, count(*) * 1 // 3) FROM customer) AS VARCHAR) END AS konami_id,
       CASE WHEN c_acctbal > 5000 THEN '+51' || CAST(c_custkey AS VARCHAR) ELSE '' END AS whatsapp,
       CASE WHEN c_custkey % 5 = 0 THEN '@c' || CAST(c_custkey AS VARCHAR) END AS instagram,
       CAST(NULL AS VARCHAR) AS facebook,
       CASE WHEN c_custkey % 9 = 0 THEN '' END AS otro
FROM customer""")

_cte("seller_regs_v", """
SELECT seq, nombres, apellidos, lower(correo) AS correo, dni,
       NULLIF(konami_id, '') AS konami_id, NULLIF(whatsapp, '') AS whatsapp,
       NULLIF(instagram, '') AS instagram, NULLIF(facebook, '') AS facebook,
       NULLIF(otro, '') AS otro,
       CASE WHEN nombres IS NULL OR nombres = '' OR apellidos IS NULL OR apellidos = ''
                 OR correo IS NULL OR correo = '' OR password IS NULL OR password = ''
                 OR dni IS NULL OR dni = '' THEN 'missing_fields'
            WHEN length(password) < 8 THEN 'short_password' END AS error
FROM seller_regs""", ("seller_regs",))

_cte("tournaments_t", """
SELECT s_suppkey AS id, 'Torneo ' || s_name AS name,
       CAST(CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey % 4) * 5 END AS INTEGER) AS participants,
       CASE WHEN s_suppkey % 11 = 7 THEN 'sin limite' ELSE CAST(20 + (s_suppkey % 3) * 20 AS VARCHAR) END AS "maxPlayers"
FROM supplier""")

_cte("joins_t", """
SELECT c_custkey AS seq, 'KID' || CAST(c_custkey AS VARCHAR) AS konamiid, c_name AS name,
       CAST(CASE WHEN c_custkey % 50 = 49 THEN -1 - c_custkey ELSE c_custkey % (SELECT greatest(1, count(*) * 37 // 100) FROM supplier) END AS BIGINT) AS idtournament
FROM customer""")

_cte("stored_players", """
SELECT c_name AS name, 'KID' || CAST(c_custkey AS VARCHAR) AS konamiid,
       CAST(c_custkey * 7 % (SELECT greatest(1, count(*) * 37 // 100) FROM supplier) AS BIGINT) AS idtournament,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS INTEGER) AS victory,
       CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 END AS INTEGER) AS defeat, CAST(NULL AS INTEGER) AS draw
FROM customer""")

# R8 closed form
_cte("admission", """
SELECT j.seq, j.idtournament, j.konamiid, j.name,
       CASE WHEN t.id IS NULL THEN 'not_found'
            WHEN (t.mx IS NULL OR t.p < t.mx)
                 AND (j.k = 1 OR t.mx IS NULL OR COALESCE(s.n, 0) + j.k - 1 < t.mx) THEN 'ok'
            ELSE 'full' END AS outcome
FROM (SELECT *, row_number() OVER (PARTITION BY idtournament ORDER BY seq) AS k FROM joins_t) j
LEFT JOIN (SELECT id, COALESCE(participants, 0) AS p,
                  TRY_CAST(NULLIF(regexp_extract("maxPlayers", '^\\s*([+-]?\\d+)', 1), '') AS INTEGER) AS mx
           FROM tournaments_t) t ON j.idtournament = t.id
LEFT JOIN (SELECT idtournament, count(*) AS n FROM stored_players GROUP BY idtournament) s
  ON j.idtournament = s.idtournament""", ("joins_t", "tournaments_t", "stored_players"))

_cte("players_t", """
SELECT name, konamiid, idtournament, victory, defeat, draw FROM stored_players
UNION ALL
SELECT name, konamiid, idtournament, CAST(NULL AS INTEGER) AS victory,
       CAST(NULL AS INTEGER) AS defeat, CAST(NULL AS INTEGER) AS draw
FROM admission WHERE outcome = 'ok'""", ("admission", "stored_players"))

_cte("results_t", """
SELECT 'KID' || CAST(c_custkey AS VARCHAR) AS konamiid,
       CAST(CASE WHEN c_custkey % 7 = 0 THEN c_custkey % (SELECT greatest(1, count(*) * 37 // 100) FROM supplier) + 1 ELSE c_custkey % (SELECT greatest(1, count(*) * 37 // 100) FROM supplier) END AS BIGINT) AS idtournament,
       CAST(c_custkey % 5 AS INTEGER) AS victory, CAST(c_custkey % 4 AS INTEGER) AS defeat,
       CAST(CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 2 END AS INTEGER) AS draw
FROM customer""")

_cte("attempts_t", """
SELECT user_id AS account_id, ts AS "at", event_type NOT IN ('error', 'view', 'click') AS password_ok
FROM events""")

# ---- the feed, flattened (shredding a nested row = these flat rows) -------------------
_cte("feed_sets", """
SELECT l_partkey AS card_id, 'SET-' || l_returnflag AS set_name,
       l_returnflag || l_linestatus AS set_code,
       CASE WHEN l_linestatus = 'O' THEN 'Common' ELSE 'Rare' END AS set_rarity,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE '(' || l_returnflag || ')' END AS set_rarity_code,
       CASE WHEN l_returnflag = 'A' THEN CAST(CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS VARCHAR)
            WHEN l_returnflag = 'R' THEN CAST(CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS VARCHAR) || 'usd'
            WHEN l_linestatus = 'O' THEN '' ELSE 'n/a' END AS set_price
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_partkey, l_returnflag, l_linestatus""")

_cte("feed_sets_new", """
SELECT l_partkey AS card_id, 'SET-' || l_returnflag AS set_name,
       l_returnflag || l_linestatus AS set_code,
       CASE WHEN l_linestatus = 'O' THEN 'Common' ELSE 'Rare' END AS set_rarity,
       CASE WHEN l_returnflag = 'N' THEN '' ELSE '(' || l_returnflag || ')' END AS set_rarity_code,
       CASE WHEN l_returnflag = 'A' THEN CAST(CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS VARCHAR)
            WHEN l_returnflag = 'R' THEN CAST(CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS VARCHAR) || 'usd'
            WHEN l_linestatus = 'O' THEN '' ELSE 'n/a' END AS set_price
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'
GROUP BY l_partkey, l_returnflag, l_linestatus""")

_cte("feed_types", """
SELECT p_partkey AS card_id, t.type_name
FROM part, LATERAL (SELECT unnest([p_type, CASE WHEN p_size % 2 = 0 THEN 'Effect' ELSE 'Normal' END,
                                   p_type]) AS type_name) t
WHERE p_size % 7 > 1""")

_cte("feed_banlist", """
SELECT p_partkey AS card_id, CASE WHEN p_size % 6 = 0 THEN 'Banned' END AS ban_ocg
FROM part WHERE p_size % 6 IN (0, 1)""")

_cte("feed_images", """
SELECT p_partkey AS card_id, 'img/' || CAST(p_partkey AS VARCHAR) AS image_url,
       CASE WHEN p_size % 2 = 0 THEN NULL ELSE 'img/s/' || CAST(p_partkey AS VARCHAR) END AS image_url_small,
       CASE WHEN p_size % 3 = 0 THEN 'img/c/' || CAST(p_partkey AS VARCHAR) END AS image_url_cropped
FROM part""")

_cte("feed_price_text", """
SELECT p_partkey AS card_id, p_size,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS cardmarket_price,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) || '$' AS tcgplayer_price,
       '' AS ebay_price, CASE WHEN p_size % 2 = 0 THEN '1,234' END AS amazon_price,
       'abc' AS coolstuffinc_price
FROM part WHERE p_size % 8 <> 0""")

FLOAT_RE = "^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)"


def _parse_float(x: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '{FLOAT_RE}', 1), '') AS DOUBLE)"


def _stored_price(x: str) -> str:
    return f"TRY_CAST(COALESCE({_parse_float(x)}, 0.0) AS DECIMAL(12,2))"


_cte("feed_printings", f"""
SELECT card_id, set_name, set_code, set_rarity, NULLIF(set_rarity_code, '') AS set_rarity_code,
       {_stored_price('set_price')} AS set_price
FROM feed_sets""", ("feed_sets",))

_cte("feed_printings_new", f"""
SELECT card_id, set_name, set_code, set_rarity, NULLIF(set_rarity_code, '') AS set_rarity_code,
       {_stored_price('set_price')} AS set_price
FROM feed_sets_new""", ("feed_sets_new",))

_cte("feed_prices", f"""
SELECT card_id, {_stored_price('cardmarket_price')} AS cardmarket_price,
       {_stored_price('tcgplayer_price')} AS tcgplayer_price, {_stored_price('ebay_price')} AS ebay_price,
       {_stored_price('amazon_price')} AS amazon_price,
       {_stored_price('coolstuffinc_price')} AS coolstuffinc_price
FROM feed_price_text""", ("feed_price_text",))


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if not order:
        return sql
    text = sql.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(head):
            return f"{head}{body},\n{text[len(head):]}"
    return f"WITH {body}\n{sql}"


def _nz(x: str) -> str:
    return f"COALESCE(CAST({x} AS VARCHAR), '~')"


_PRINT_TEXT = ("concat_ws('/', " + ", ".join(_nz(c) for c in (
    "set_name", "set_code", "set_rarity", "set_rarity_code", "CAST(set_price AS VARCHAR)")) + ")")
_IMG_TEXT = ("concat_ws('/', " + ", ".join(_nz(c) for c in (
    "card_id", "image_url", "image_url_small", "image_url_cropped")) + ")")
_PRICE_TEXT = ("concat_ws('/', " + ", ".join(_nz(c) for c in (
    "cardmarket_price", "tcgplayer_price", "ebay_price", "amazon_price", "coolstuffinc_price")) + ")")

INV_COLS = ("inventario_id, vendedor_id, card_id, cantidad, precio, condicion, idioma, edicion, "
            "notas, created_at, updated_at")
NOW = "TIMESTAMP '2002-01-01 00:00:00'"

Q: dict[str, str] = {}

# ---- sources ---------------------------------------------------------------------
Q["q_scan_tournaments"] = with_ctes("SELECT * FROM tournaments_t", "tournaments_t")
Q["q_inventory_detail"] = with_ctes("SELECT * FROM detail", "detail")
Q["q_ingest_report"] = with_ctes("""
SELECT (SELECT count(*) FROM part) AS cards,
       (SELECT count(*) FROM feed_types) AS types,
       (SELECT count(*) FROM feed_sets) AS printings,
       (SELECT count(*) FROM feed_banlist) AS banlist,
       (SELECT count(*) FROM feed_images) AS images,
       (SELECT count(*) FROM feed_price_text) AS prices""",
    "feed_types", "feed_sets", "feed_banlist", "feed_images", "feed_price_text")
Q["q_ingest_catalog"] = with_ctes("""
WITH batch AS (SELECT DISTINCT card_id AS id FROM feed_sets_new),
types AS (SELECT id AS card_id, type AS type_name FROM cards WHERE id NOT IN (SELECT id FROM batch)
          UNION ALL
          SELECT DISTINCT card_id, type_name FROM feed_types WHERE card_id IN (SELECT id FROM batch)),
ban AS (SELECT id AS card_id, CASE WHEN level % 4 = 0 THEN 'Limited' END AS ban_ocg FROM cards
        WHERE id NOT IN (SELECT card_id FROM feed_banlist WHERE card_id IN (SELECT id FROM batch))
        UNION ALL
        SELECT card_id, ban_ocg FROM feed_banlist WHERE card_id IN (SELECT id FROM batch)),
printings AS (SELECT * FROM feed_printings WHERE card_id NOT IN (SELECT id FROM batch)
              UNION ALL SELECT * FROM feed_printings_new)
SELECT 'cards' AS table_name, concat_ws('|', COALESCE(CAST(id AS VARCHAR), '~'), COALESCE(CAST(name AS VARCHAR), '~'),
         COALESCE(CAST(type AS VARCHAR), '~'), COALESCE(CAST(human_readable_card_type AS VARCHAR), '~'),
         COALESCE(CAST(frame_type AS VARCHAR), '~'), COALESCE(CAST(description AS VARCHAR), '~'),
         COALESCE(CAST(race AS VARCHAR), '~'), COALESCE(CAST(atk AS VARCHAR), '~'),
         COALESCE(CAST(def AS VARCHAR), '~'), COALESCE(CAST(level AS VARCHAR), '~'),
         COALESCE(CAST(attribute AS VARCHAR), '~'), COALESCE(CAST(archetype AS VARCHAR), '~'),
         COALESCE(CAST(ygoprodeck_url AS VARCHAR), '~')) AS row FROM cards
UNION ALL SELECT 'card_types' AS table_name, concat_ws('|', COALESCE(CAST(card_id AS VARCHAR), '~'), COALESCE(CAST(type_name AS VARCHAR), '~')) AS row FROM types
UNION ALL SELECT 'card_printings' AS table_name, concat_ws('|', COALESCE(CAST(card_id AS VARCHAR), '~'), COALESCE(CAST(set_name AS VARCHAR), '~'),
         COALESCE(CAST(set_code AS VARCHAR), '~'), COALESCE(CAST(set_rarity AS VARCHAR), '~'),
         COALESCE(CAST(set_rarity_code AS VARCHAR), '~'), COALESCE(CAST(set_price AS VARCHAR), '~')) AS row FROM printings
UNION ALL SELECT 'banlist_info' AS table_name, concat_ws('|', COALESCE(CAST(card_id AS VARCHAR), '~'), COALESCE(CAST(ban_ocg AS VARCHAR), '~')) AS row FROM ban
UNION ALL SELECT 'card_images' AS table_name, concat_ws('|', COALESCE(CAST(card_id AS VARCHAR), '~'), COALESCE(CAST(image_url AS VARCHAR), '~'),
         COALESCE(CAST(image_url_small AS VARCHAR), '~'), COALESCE(CAST(image_url_cropped AS VARCHAR), '~')) AS row FROM feed_images
UNION ALL SELECT 'card_prices' AS table_name, concat_ws('|', COALESCE(CAST(card_id AS VARCHAR), '~'),
         COALESCE(CAST(cardmarket_price AS VARCHAR), '~'), COALESCE(CAST(tcgplayer_price AS VARCHAR), '~'),
         COALESCE(CAST(ebay_price AS VARCHAR), '~'), COALESCE(CAST(amazon_price AS VARCHAR), '~'),
         COALESCE(CAST(coolstuffinc_price AS VARCHAR), '~')) AS row FROM feed_prices""",
    "cards", "feed_types", "feed_banlist", "feed_printings", "feed_printings_new", "feed_sets_new",
    "feed_images", "feed_prices")
Q["q_unnest_zip"] = with_ctes("""
SELECT p.p_partkey AS id, z.type_name, z.set_name
FROM part p,
LATERAL (
  SELECT unnest(CASE WHEN p.p_size % 7 > 1
                     THEN [p.p_type, CASE WHEN p.p_size % 2 = 0 THEN 'Effect' ELSE 'Normal' END, p.p_type]
                     ELSE CAST([] AS VARCHAR[]) END) AS type_name,
         unnest(COALESCE((SELECT list(s.set_name ORDER BY s.set_name, s.set_code) FROM feed_sets s
                          WHERE s.card_id = p.p_partkey), CAST([] AS VARCHAR[]))) AS set_name
) z""", "feed_sets")

# ---- projections / filters --------------------------------------------------------------
Q["q_seller_public"] = with_ctes("""
SELECT vendedor_id, nombres, apellidos, correo, dni, konami_id, whatsapp, instagram, facebook,
       otro, ultimo_login, created_at, updated_at, activo, email_verificado
FROM vendedores""", "vendedores")
Q["q_seller_by_konami"] = with_ctes("""
SELECT konami_id, vendedor_id, nombres, apellidos, whatsapp, instagram, facebook, otro
FROM vendedores WHERE activo AND konami_id IN (SELECT konami_id FROM seller_regs)""",
    "vendedores", "seller_regs")
_MY_INV = """
SELECT i.vendedor_id, i.inventario_id, i.card_id, c.name, c.type, c.race, c.attribute, c.archetype,
       c.atk, c.def, c.level, i.cantidad, i.precio, i.condicion, i.idioma, i.edicion, i.notas,
       i.created_at, i.updated_at
FROM inventario i JOIN cards c ON i.card_id = c.id
WHERE i.cantidad > 0 {extra}"""
Q["q_my_inventory"] = with_ctes(_MY_INV.format(extra="""
  AND i.vendedor_id IN (SELECT vendedor_id FROM vendedores)
  AND i.condicion = 'R' AND c.name ILIKE '%ro%' ESCAPE '\\'"""), "inventario", "cards", "vendedores")
Q["q_my_inventory_by_price"] = with_ctes(_MY_INV.format(extra="AND i.idioma = 'F'"),
                                         "inventario", "cards")
Q["q_user_lookup"] = with_ctes("""
WITH logins AS (SELECT email AS login FROM user_regs UNION SELECT username FROM users_t)
SELECT DISTINCT l.login, u.id, u.username, u.email, u.dni, u.user_type,
       CASE WHEN u.is_active THEN 'ok' ELSE 'inactive' END AS status
FROM logins l JOIN users_t u ON l.login = u.username OR l.login = u.email""",
    "user_regs", "users_t")
_CONFLICT = """
SELECT r.seq, (SELECT CASE WHEN u.{k0} = r.{k0} THEN '{k0}' WHEN u.{k1} = r.{k1} THEN '{k1}'
                           WHEN u.{k2} = r.{k2} THEN '{k2}' END
               FROM {stored} u WHERE u.{k0} = r.{k0} OR u.{k1} = r.{k1} OR u.{k2} = r.{k2}
               ORDER BY u.{id} LIMIT 1) AS conflict_field
FROM {regs} r WHERE r.error IS NULL"""
Q["q_user_conflicts"] = with_ctes(_CONFLICT.format(k0="username", k1="email", k2="dni",
                                                   stored="users_t", id="id", regs="user_regs_v"),
                                  "users_t", "user_regs_v")
Q["q_seller_search_page"] = with_ctes("""
SELECT vendedor_id, nombres, apellidos, konami_id, whatsapp, instagram, facebook, otro, created_at
FROM vendedores
WHERE activo AND (nombres ILIKE '%1%' ESCAPE '\\' OR apellidos ILIKE '%1%' ESCAPE '\\'
                  OR konami_id ILIKE '%1%' ESCAPE '\\')
ORDER BY created_at DESC NULLS FIRST, vendedor_id LIMIT 20 OFFSET 5""", "vendedores")
Q["q_card_offers"] = with_ctes("""
SELECT card_id, inventario_id, vendedor_id, vendedor_nombre, konami_id, whatsapp, instagram,
       card_name, cantidad, precio, condicion, idioma, edicion, notas, created_at, updated_at
FROM detail WHERE card_id IN (SELECT id FROM cards) AND idioma = 'F'
  AND CAST(precio AS DOUBLE) <= 50000.5""", "detail", "cards")
Q["q_active_seller_count"] = with_ctes("SELECT count(*) AS total FROM vendedores WHERE activo",
                                       "vendedores")
Q["q_semi_by_keys"] = with_ctes("""
SELECT * FROM feed_printings
WHERE card_id IN (SELECT id FROM cards WHERE name ILIKE '%ring%' ESCAPE '\\')""",
    "feed_printings", "cards")
Q["q_semi_exists"] = with_ctes("""
SELECT id, username FROM users_t
WHERE EXISTS (SELECT 1 FROM roles_t r WHERE r.user_id = users_t.id AND r.role = 'vendedor')""",
    "users_t", "roles_t")
Q["q_anti_missing"] = with_ctes("""
SELECT id, username FROM users_t
WHERE NOT EXISTS (SELECT 1 FROM roles_t r WHERE r.user_id = users_t.id AND r.role = 'admin')""",
    "users_t", "roles_t")
Q["q_validate_users"] = with_ctes("SELECT seq, error FROM user_regs_v", "user_regs_v")
Q["q_role_filter"] = with_ctes("""
SELECT u.id, u.username, string_agg(r.role, ',' ORDER BY r.role) AS roles
FROM users_t u JOIN roles_t r ON r.user_id = u.id
GROUP BY u.id, u.username HAVING bool_or(r.role = 'vendedor')""", "users_t", "roles_t")

_BULK_FOLD = """
SELECT inventario_id, vendedor_id, card_id, cantidad, f.precio AS precio, f.condicion AS condicion,
       f.idioma AS idioma, f.edicion AS edicion, f.notas AS notas FROM (
  SELECT vendedor_id * 1000000000 + card_id AS inventario_id, vendedor_id, card_id,
         SUM(cantidad) AS cantidad,
         arg_min(struct_pack(precio := precio, condicion := condicion, idioma := idioma,
                             edicion := edicion, notas := notas), seq) AS f
  FROM inv_new GROUP BY vendedor_id, card_id)"""
Q["q_bulk_upsert"] = with_ctes(f"""
WITH n AS ({_BULK_FOLD})
SELECT COALESCE(b.inventario_id, n.inventario_id) AS inventario_id,
       COALESCE(b.vendedor_id, n.vendedor_id) AS vendedor_id, COALESCE(b.card_id, n.card_id) AS card_id,
       CASE WHEN b.card_id IS NOT NULL AND n.card_id IS NOT NULL THEN b.cantidad + n.cantidad
            WHEN b.card_id IS NOT NULL THEN b.cantidad ELSE n.cantidad END AS cantidad,
       CASE WHEN b.card_id IS NOT NULL THEN b.precio ELSE n.precio END AS precio,
       CASE WHEN b.card_id IS NOT NULL THEN b.condicion ELSE n.condicion END AS condicion,
       CASE WHEN b.card_id IS NOT NULL THEN b.idioma ELSE n.idioma END AS idioma,
       CASE WHEN b.card_id IS NOT NULL THEN b.edicion ELSE n.edicion END AS edicion,
       CASE WHEN b.card_id IS NOT NULL THEN b.notas ELSE n.notas END AS notas,
       COALESCE(b.created_at, {NOW}) AS created_at,
       CASE WHEN n.card_id IS NOT NULL THEN {NOW} ELSE b.updated_at END AS updated_at
FROM inv_base b FULL OUTER JOIN n ON b.vendedor_id = n.vendedor_id AND b.card_id = n.card_id""",
    "inv_base", "inv_new")

# ---- joins -----------------------------------------------------------------------------
_DOC = f"""
SELECT c.id, c.name, c.type, c.human_readable_card_type AS "humanReadableCardType",
       c.frame_type AS "frameType", c.description AS "desc", c.race, c.atk, c.def, c.level,
       c.attribute, c.archetype, c.ygoprodeck_url,
       COALESCE((SELECT string_agg(type_name, '|' ORDER BY type_name) FROM feed_types t
                 WHERE t.card_id = c.id), '') AS typeline,
       COALESCE((SELECT string_agg({_PRINT_TEXT}, '|' ORDER BY set_name, set_code, set_rarity,
                                   set_rarity_code, CAST(set_price AS VARCHAR))
                 FROM feed_printings p WHERE p.card_id = c.id), '') AS card_sets,
       EXISTS (SELECT 1 FROM feed_banlist b WHERE b.card_id = c.id) AS has_banlist,
       (SELECT max(ban_ocg) FROM feed_banlist b WHERE b.card_id = c.id) AS ban_ocg,
       COALESCE((SELECT string_agg({_IMG_TEXT}, '|' ORDER BY image_url, image_url_small,
                                   image_url_cropped)
                 FROM feed_images i WHERE i.card_id = c.id), '') AS card_images,
       COALESCE((SELECT string_agg({_PRICE_TEXT}, '|' ORDER BY cardmarket_price)
                 FROM feed_prices pr WHERE pr.card_id = c.id), '') AS card_prices
FROM cards c WHERE c.name ILIKE '%ring%' ESCAPE '\\'"""
Q["q_search_nested"] = with_ctes(_DOC, "cards", "feed_types", "feed_printings", "feed_banlist",
                                 "feed_images", "feed_prices")
_JSON_BODY = """
  'id', c.id, 'name', c.name,
  'typeline', COALESCE((SELECT list(type_name ORDER BY type_name) FROM feed_types t
                        WHERE t.card_id = c.id), CAST([] AS VARCHAR[])),
  'type', c.type, 'humanReadableCardType', c.human_readable_card_type, 'frameType', c.frame_type,
  'desc', c.description, 'race', c.race, 'atk', c.atk, 'def', c.def, 'level', c.level,
  'attribute', c.attribute, 'archetype', c.archetype, 'ygoprodeck_url', c.ygoprodeck_url,
  'card_sets', COALESCE((SELECT list({'set_name': set_name, 'set_code': set_code, 'set_rarity': set_rarity,
                                      'set_rarity_code': set_rarity_code,
                                      'set_price': CAST(set_price AS VARCHAR)}
                                     ORDER BY set_name, set_code)
                         FROM feed_printings p WHERE p.card_id = c.id), []),
  {ban}
  'card_images', COALESCE((SELECT list({'id': card_id, 'image_url': image_url,
                                        'image_url_small': image_url_small,
                                        'image_url_cropped': image_url_cropped} ORDER BY image_url)
                           FROM feed_images i WHERE i.card_id = c.id), []),
  'card_prices', COALESCE((SELECT list({'cardmarket_price': CAST(cardmarket_price AS VARCHAR),
                                        'tcgplayer_price': CAST(tcgplayer_price AS VARCHAR),
                                        'ebay_price': CAST(ebay_price AS VARCHAR),
                                        'amazon_price': CAST(amazon_price AS VARCHAR),
                                        'coolstuffinc_price': CAST(coolstuffinc_price AS VARCHAR)}
                                       ORDER BY cardmarket_price)
                           FROM feed_prices pr WHERE pr.card_id = c.id), [])"""
_BAN_FIELD = ("'banlist_info', (SELECT json_object('ban_ocg', ban_ocg) FROM feed_banlist b "
              "WHERE b.card_id = c.id),")
Q["q_search_nested_json"] = with_ctes(f"""
SELECT c.id,
       CASE WHEN EXISTS (SELECT 1 FROM feed_banlist b WHERE b.card_id = c.id)
            THEN CAST(to_json(json_object({_JSON_BODY.replace("{ban}", _BAN_FIELD)})) AS VARCHAR)
            ELSE CAST(to_json(json_object({_JSON_BODY.replace("{ban}", "")})) AS VARCHAR) END AS doc
FROM cards c WHERE c.name ILIKE '%ring%' ESCAPE '\\'""", "cards", "feed_types", "feed_printings",
    "feed_banlist", "feed_images", "feed_prices")
Q["q_user_roles"] = with_ctes("""
SELECT u.id, u.username, u.user_type, u.is_active,
       COALESCE((SELECT string_agg(role, ',' ORDER BY role) FROM roles_t r WHERE r.user_id = u.id), '') AS roles
FROM users_t u""", "users_t", "roles_t")
_UPDATES = """
SELECT inventario_id,
       CASE WHEN card_id % 5 = 0 THEN vendedor_id + 1 ELSE vendedor_id END AS vendedor_id,
       CASE WHEN cantidad % 4 <> 0 THEN cantidad * 2 END AS u_cantidad,
       CASE WHEN card_id % 3 = 0 THEN CAST(0 AS DECIMAL(12,2)) WHEN card_id % 3 = 1 THEN precio + 1 END AS u_precio,
       CASE WHEN card_id % 2 = 0 THEN '' END AS u_condicion,
       CASE WHEN edicion IS NULL THEN '1st' END AS u_edicion
FROM inventario"""
Q["q_guarded_update"] = with_ctes(f"""
WITH u AS ({_UPDATES}),
ok AS (SELECT u.* FROM u JOIN inventario i ON u.inventario_id = i.inventario_id AND u.vendedor_id = i.vendedor_id)
SELECT i.inventario_id, i.vendedor_id, i.card_id, COALESCE(ok.u_cantidad, i.cantidad) AS cantidad,
       COALESCE(ok.u_precio, i.precio) AS precio, COALESCE(ok.u_condicion, i.condicion) AS condicion,
       i.idioma, COALESCE(ok.u_edicion, i.edicion) AS edicion, i.notas, i.created_at, i.updated_at
FROM inventario i LEFT JOIN ok ON i.inventario_id = ok.inventario_id""", "inventario")

# ---- aggregations ------------------------------------------------------------------------
Q["q_card_count"] = "SELECT count(*) AS total_cards FROM part"
Q["q_tournament_counts"] = with_ctes("""
SELECT idtournament, count(*) AS participants FROM players_t GROUP BY idtournament""", "players_t")
_STATS = """count(*) AS total_cartas_unicas, sum(cantidad) AS total_cartas,
       round(CAST(avg(precio) AS DOUBLE), 6) AS precio_promedio, max(precio) AS precio_maximo"""
Q["q_inventory_stats"] = with_ctes(f"""
WITH a AS (SELECT vendedor_id, {_STATS} FROM inventario WHERE cantidad > 0 GROUP BY vendedor_id)
SELECT s.vendedor_id, COALESCE(a.total_cartas_unicas, 0) AS total_cartas_unicas, a.total_cartas,
       a.precio_promedio, a.precio_maximo
FROM (SELECT DISTINCT vendedor_id FROM vendedores) s LEFT JOIN a ON s.vendedor_id = a.vendedor_id""",
    "inventario", "vendedores")
Q["q_inventory_stats_one"] = with_ctes(f"SELECT {_STATS} FROM inventario WHERE cantidad > 0",
                                       "inventario")
Q["q_nest_types"] = with_ctes("""
SELECT card_id, string_agg(type_name, '|' ORDER BY type_name) AS typeline
FROM feed_types GROUP BY card_id""", "feed_types")
Q["q_nest_printings"] = with_ctes(f"""
SELECT card_id, string_agg({_PRINT_TEXT}, '|' ORDER BY set_name, set_code, set_rarity,
                           set_rarity_code, CAST(set_price AS VARCHAR)) AS card_sets
FROM feed_printings GROUP BY card_id""", "feed_printings")
Q["q_nest_images_prices"] = with_ctes(f"""
WITH i AS (SELECT card_id, string_agg({_IMG_TEXT}, '|' ORDER BY image_url) AS card_images
           FROM feed_images GROUP BY card_id),
     p AS (SELECT card_id, string_agg({_PRICE_TEXT}, '|' ORDER BY cardmarket_price) AS card_prices
           FROM feed_prices GROUP BY card_id)
SELECT COALESCE(i.card_id, p.card_id) AS card_id, COALESCE(i.card_images, '') AS card_images,
       COALESCE(p.card_prices, '') AS card_prices
FROM i FULL OUTER JOIN p ON i.card_id = p.card_id""", "feed_images", "feed_prices")
Q["q_nest_banlist"] = with_ctes("SELECT card_id, ban_ocg FROM feed_banlist", "feed_banlist")
_TOPK = """
SELECT inventario_id, vendedor_id, card_id, card_name, precio FROM detail
WHERE card_name ILIKE '%r_d%' ESCAPE '\\'
ORDER BY precio ASC NULLS LAST, inventario_id LIMIT 20"""
Q["q_name_offers_total"] = with_ctes(f"SELECT count(*) AS total FROM ({_TOPK}) t", "detail")
Q["q_upsert_ignore"] = with_ctes("""
SELECT id AS card_id, type AS type_name FROM cards
UNION ALL
SELECT DISTINCT t.card_id, t.type_name FROM feed_types t
WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.id = t.card_id AND c.type = t.type_name)""",
    "cards", "feed_types")

# ---- sort / limit / ordered -----------------------------------------------------------
Q["q_seller_inventory"] = with_ctes(
    "SELECT * FROM detail WHERE card_name ILIKE '%gear%' ESCAPE '\\'", "detail")
Q["q_name_offers_topk"] = with_ctes(_TOPK, "detail")
Q["q_offers_nested"] = with_ctes("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY vendedor_id
                                        ORDER BY card_name ASC NULLS LAST, inventario_id) AS line_no
           FROM detail)
SELECT vendedor_id, CAST((line_no - 1) // 50 AS BIGINT) AS page, max(vendedor_nombre) AS nombre,
       max(konami_id) AS konami_id, max(whatsapp) AS whatsapp, max(instagram) AS instagram,
       count(*) AS n_items,
       string_agg(CAST(line_no AS VARCHAR) || ':' || CAST(inventario_id AS VARCHAR), ','
                  ORDER BY line_no) AS items
FROM n GROUP BY vendedor_id, (line_no - 1) // 50""", "detail")
Q["q_bulk_running_qty"] = with_ctes("""
WITH r AS (SELECT vendedor_id, card_id, seq, cantidad,
                  row_number() OVER w AS line_no, sum(cantidad) OVER w AS running
           FROM inv_new WINDOW w AS (PARTITION BY vendedor_id, card_id ORDER BY seq
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT r.vendedor_id, r.card_id, r.line_no, r.cantidad AS added,
       CASE WHEN b.card_id IS NOT NULL THEN b.cantidad + r.running ELSE r.running END AS cantidad
FROM r LEFT JOIN inv_base b ON r.vendedor_id = b.vendedor_id AND r.card_id = b.card_id""",
    "inv_new", "inv_base")
Q["q_best_offers_per_card"] = with_ctes("""
SELECT card_id, rank, inventario_id, precio FROM (
  SELECT card_id, inventario_id, precio,
         row_number() OVER (PARTITION BY card_id ORDER BY precio ASC NULLS LAST, inventario_id) AS rank
  FROM detail) WHERE rank <= 3""", "detail")

# ---- keyed changes -------------------------------------------------------------------
Q["q_upsert_partial"] = with_ctes("""
WITH n AS (
  SELECT CASE WHEN level % 10 = 0 THEN -1 - id ELSE id END AS id, name || ' v2' AS name,
         'NEW ' || type AS type, human_readable_card_type, frame_type, upper(description) AS description,
         'Zombie' AS race, CASE WHEN level % 3 <> 0 THEN atk + 1 END AS atk, def, level, attribute,
         archetype, ygoprodeck_url || '/new' AS ygoprodeck_url
  FROM cards)
SELECT COALESCE(b.id, n.id) AS id,
       CASE WHEN n.id IS NOT NULL THEN n.name ELSE b.name END AS name,
       CASE WHEN b.id IS NOT NULL THEN b.type ELSE n.type END AS type,
       CASE WHEN b.id IS NOT NULL THEN b.human_readable_card_type ELSE n.human_readable_card_type END AS human_readable_card_type,
       CASE WHEN b.id IS NOT NULL THEN b.frame_type ELSE n.frame_type END AS frame_type,
       CASE WHEN n.id IS NOT NULL THEN n.description ELSE b.description END AS description,
       CASE WHEN b.id IS NOT NULL THEN b.race ELSE n.race END AS race,
       CASE WHEN n.id IS NOT NULL THEN n.atk ELSE b.atk END AS atk,
       CASE WHEN n.id IS NOT NULL THEN n.def ELSE b.def END AS def,
       CASE WHEN n.id IS NOT NULL THEN n.level ELSE b.level END AS level,
       CASE WHEN n.id IS NOT NULL THEN n.attribute ELSE b.attribute END AS attribute,
       CASE WHEN n.id IS NOT NULL THEN n.archetype ELSE b.archetype END AS archetype,
       CASE WHEN b.id IS NOT NULL THEN b.ygoprodeck_url ELSE n.ygoprodeck_url END AS ygoprodeck_url
FROM cards b FULL OUTER JOIN n ON b.id = n.id""", "cards")
Q["q_batch_duplicates"] = with_ctes("""
SELECT card_id, type_name, count(*) AS occurrences FROM feed_types
GROUP BY card_id, type_name HAVING count(*) > 1""", "feed_types")
_ADD_FOLD = """
SELECT vendedor_id, card_id, SUM(cantidad) AS cantidad,
       arg_max(precio, seq) FILTER (WHERE precio IS NOT NULL) AS precio,
       arg_max(condicion, seq) AS condicion, arg_max(idioma, seq) AS idioma,
       arg_max(edicion, seq) FILTER (WHERE edicion IS NOT NULL) AS edicion,
       arg_max(notas, seq) FILTER (WHERE notas IS NOT NULL) AS notas
FROM inv_new WHERE card_id IN (SELECT id FROM cards) GROUP BY vendedor_id, card_id"""
Q["q_upsert_additive"] = with_ctes(f"""
WITH n AS ({_ADD_FOLD})
SELECT COALESCE(b.inventario_id, n.vendedor_id * 1000000000 + n.card_id) AS inventario_id,
       COALESCE(b.vendedor_id, n.vendedor_id) AS vendedor_id, COALESCE(b.card_id, n.card_id) AS card_id,
       CASE WHEN b.card_id IS NOT NULL AND n.card_id IS NOT NULL THEN b.cantidad + n.cantidad
            WHEN b.card_id IS NOT NULL THEN b.cantidad ELSE n.cantidad END AS cantidad,
       CASE WHEN n.card_id IS NOT NULL THEN COALESCE(n.precio, b.precio) ELSE b.precio END AS precio,
       CASE WHEN n.card_id IS NOT NULL THEN COALESCE(n.condicion, b.condicion) ELSE b.condicion END AS condicion,
       CASE WHEN n.card_id IS NOT NULL THEN COALESCE(n.idioma, b.idioma) ELSE b.idioma END AS idioma,
       CASE WHEN n.card_id IS NOT NULL THEN COALESCE(n.edicion, b.edicion) ELSE b.edicion END AS edicion,
       CASE WHEN n.card_id IS NOT NULL THEN COALESCE(n.notas, b.notas) ELSE b.notas END AS notas,
       COALESCE(b.created_at, {NOW}) AS created_at,
       CASE WHEN n.card_id IS NOT NULL THEN {NOW} ELSE b.updated_at END AS updated_at
FROM inv_base b FULL OUTER JOIN n ON b.vendedor_id = n.vendedor_id AND b.card_id = n.card_id""",
    "inv_base", "inv_new", "cards")
Q["q_upsert_banlist"] = with_ctes("""
WITH b AS (SELECT id AS card_id, CASE WHEN level % 4 = 0 THEN 'Limited' END AS ban_ocg FROM cards)
SELECT COALESCE(b.card_id, n.card_id) AS card_id,
       CASE WHEN n.card_id IS NOT NULL THEN n.ban_ocg ELSE b.ban_ocg END AS ban_ocg
FROM b FULL OUTER JOIN feed_banlist n ON b.card_id = n.card_id""", "cards", "feed_banlist")
Q["q_replace_children"] = with_ctes("""
SELECT * FROM feed_printings WHERE card_id NOT IN (SELECT card_id FROM feed_sets_new)
UNION ALL
SELECT * FROM feed_printings_new""", "feed_printings", "feed_printings_new", "feed_sets_new")
Q["q_coalesce_update"] = with_ctes("""
SELECT vendedor_id,
       COALESCE(CASE WHEN vendedor_id % 2 = 0 THEN upper(nombres) END, nombres) AS nombres,
       apellidos,
       COALESCE(CASE WHEN vendedor_id % 5 = 0 THEN '' END, konami_id) AS konami_id,
       COALESCE(CASE WHEN vendedor_id % 3 = 1 THEN '+1' END, whatsapp) AS whatsapp,
       instagram,
       COALESCE(CASE WHEN vendedor_id % 4 = 1 THEN 'fb' END, facebook) AS facebook,
       otro
FROM vendedores""", "vendedores")
Q["q_guarded_delete"] = with_ctes(f"""
SELECT {INV_COLS} FROM inventario i
WHERE NOT (i.precio IS NULL AND i.card_id % 4 <> 0)""", "inventario")
Q["q_set_results"] = with_ctes("""
SELECT p.name, p.konamiid, p.idtournament,
       CASE WHEN r.konamiid IS NOT NULL THEN r.victory ELSE p.victory END AS victory,
       CASE WHEN r.konamiid IS NOT NULL THEN r.defeat ELSE p.defeat END AS defeat,
       CASE WHEN r.konamiid IS NOT NULL THEN r.draw ELSE p.draw END AS draw
FROM players_t p LEFT JOIN results_t r ON p.konamiid = r.konamiid AND p.idtournament = r.idtournament""",
    "players_t", "results_t")
Q["q_touch_rows"] = with_ctes(f"""
SELECT u.id, u.username,
       CASE WHEN u.is_active AND (u.username IN (SELECT email FROM user_regs)
                                  OR u.email IN (SELECT email FROM user_regs))
            THEN {NOW} ELSE u.updated_at END AS updated_at
FROM users_t u""", "users_t", "user_regs")
Q["q_refresh_counts"] = with_ctes("""
SELECT t.id, t.name, COALESCE(c.n, t.participants) AS participants, t."maxPlayers"
FROM tournaments_t t
LEFT JOIN (SELECT idtournament, CAST(count(*) AS INTEGER) AS n FROM players_t
           WHERE idtournament IN (SELECT idtournament FROM admission WHERE outcome = 'ok') GROUP BY idtournament) c
  ON t.id = c.idtournament""", "tournaments_t", "players_t", "admission")
Q["q_upgrade_sellers"] = with_ctes(f"""
WITH has AS (SELECT DISTINCT user_id FROM roles_t WHERE role = 'vendedor'),
roles2 AS (SELECT user_id, role FROM roles_t
           UNION ALL SELECT id, 'vendedor' FROM users_t WHERE id NOT IN (SELECT user_id FROM has))
SELECT u.id,
       CASE WHEN u.id IN (SELECT user_id FROM has) THEN u.user_type ELSE 'vendedor' END AS user_type,
       CASE WHEN u.id IN (SELECT user_id FROM has) THEN u.updated_at ELSE {NOW} END AS updated_at,
       (SELECT string_agg(role, ',' ORDER BY role) FROM roles2 r WHERE r.user_id = u.id) AS roles
FROM users_t u""", "users_t", "roles_t")

# ---- scalar functions -------------------------------------------------------------------
Q["q_feed_shred_cards"] = with_ctes("SELECT * FROM cards", "cards")
Q["q_feed_landed"] = with_ctes(f"""
SELECT c.*, CAST(COALESCE(s.n, 0) AS INTEGER) AS n_sets, COALESCE(s.sets, '') AS sets, COALESCE(t.types, '') AS types,
       c.level % 6 IN (0, 1) AS has_banlist
FROM cards c
LEFT JOIN (SELECT card_id, count(*) AS n, string_agg(x, '|' ORDER BY x) AS sets
           FROM (SELECT card_id, concat_ws('/', {_nz('set_code')}, {_nz('set_rarity_code')}, {_nz('set_price')}) AS x
                 FROM feed_sets) GROUP BY card_id) s ON s.card_id = c.id
LEFT JOIN (SELECT p_partkey, concat_ws('|', p_type, CASE WHEN p_size % 2 = 0 THEN 'Effect' ELSE 'Normal' END, p_type) AS types
           FROM part WHERE p_size % 7 > 1) t ON t.p_partkey = c.id""", "cards", "feed_sets")
Q["q_feed_shred_types"] = with_ctes("SELECT * FROM feed_types", "feed_types")
Q["q_feed_shred_printings"] = with_ctes("SELECT * FROM feed_printings", "feed_printings")
Q["q_feed_shred_banlist"] = with_ctes("SELECT * FROM feed_banlist", "feed_banlist")
Q["q_feed_shred_images"] = with_ctes("SELECT * FROM feed_images", "feed_images")
Q["q_feed_shred_prices"] = with_ctes("SELECT * FROM feed_prices", "feed_prices")
Q["q_parse_price"] = with_ctes(f"""
SELECT card_id AS id, set_code, set_price AS price_text, {_parse_float('set_price')} AS parsed,
       {_stored_price('set_price')} AS stored
FROM feed_sets""", "feed_sets")
_INT = "TRY_CAST(NULLIF(regexp_extract(text, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)"
Q["q_parse_int"] = with_ctes(f"""
SELECT k, text, {_INT} AS parsed FROM (
  SELECT id AS k, "maxPlayers" AS text FROM tournaments_t
  UNION ALL SELECT card_id AS k, set_price AS text FROM feed_sets)""", "tournaments_t", "feed_sets")
Q["q_falsy_defaults"] = with_ctes("""
SELECT vendedor_id, card_id, "at", l_orderkey, l_linenumber,
       CASE WHEN cantidad IS NULL OR cantidad = 0 THEN 1 ELSE cantidad END AS cantidad,
       CASE WHEN precio = 0 THEN NULL ELSE precio END AS precio,
       COALESCE(NULLIF(condicion, ''), 'Near Mint') AS condicion,
       COALESCE(NULLIF(idioma, ''), 'Inglés') AS idioma, NULLIF(edicion, '') AS edicion
FROM inv_lines""", "inv_lines")
Q["q_validate_sellers"] = with_ctes(
    "SELECT seq, correo, konami_id, whatsapp, otro, error FROM seller_regs_v", "seller_regs_v")
Q["q_blank_names"] = with_ctes("""
SELECT seq, CASE WHEN seq % 7 = 0 THEN '   ' ELSE nombres END AS nombres,
       (CASE WHEN seq % 7 = 0 THEN '   ' ELSE nombres END) IS NULL
       OR regexp_matches(CASE WHEN seq % 7 = 0 THEN '   ' ELSE nombres END, '^\\s*$') AS blank
FROM seller_regs""", "seller_regs")
Q["q_search_cards"] = with_ctes("""
SELECT id, name, type, human_readable_card_type AS "humanReadableCardType", frame_type AS "frameType",
       description AS "desc", race, atk, def, level, attribute, archetype, ygoprodeck_url
FROM cards WHERE name ILIKE '%ring%' ESCAPE '\\'""", "cards")

# ---- rules -----------------------------------------------------------------------------
Q["q_seller_conflicts"] = with_ctes(_CONFLICT.format(
    k0="correo", k1="dni", k2="konami_id", stored="vendedores", id="vendedor_id",
    regs="seller_regs_v"), "vendedores", "seller_regs_v")
Q["q_tournament_admission"] = with_ctes("SELECT seq, idtournament, outcome FROM admission",
                                        "admission")
# One-by-one replay of the candidates (valid, no stored conflict) in arrival
# order; the state is the key lists of the accepted requests (one row, USING KEY).
# {a} {b} {c}: the unique keys in the order in which conflicts are reported
_REPLAY = """
WITH RECURSIVE hits0 AS (
  SELECT r.seq, u.{id} AS id, 0 AS rk FROM {regs} r JOIN {stored} u ON u.{a} = r.{a} WHERE r.error IS NULL
  UNION ALL SELECT r.seq, u.{id}, 1 FROM {regs} r JOIN {stored} u ON u.{b} = r.{b} WHERE r.error IS NULL
  UNION ALL SELECT r.seq, u.{id}, 2 FROM {regs} r JOIN {stored} u ON u.{c} = r.{c} WHERE r.error IS NULL),
stored_first AS (SELECT seq, min([id, rk]) AS m FROM hits0 GROUP BY seq),
stored_hit AS (
  SELECT r.seq, CASE m[2] WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' WHEN 2 THEN '{c}' END AS cf
  FROM {regs} r LEFT JOIN stored_first s ON r.seq = s.seq WHERE r.error IS NULL),
cand AS MATERIALIZED (
  SELECT r.seq, r.{a} AS ka, r.{b} AS kb, r.{c} AS kc, row_number() OVER (ORDER BY r.seq) AS rn
  FROM {regs} r JOIN stored_hit h ON r.seq = h.seq WHERE h.cf IS NULL),
walk(k, rn, us, es, ds, acc) USING KEY (k) AS (
  SELECT 1, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT 1, c.rn,
         CASE WHEN ok AND c.ka IS NOT NULL THEN list_append(w.us, c.ka) ELSE w.us END,
         CASE WHEN ok AND c.kb IS NOT NULL THEN list_append(w.es, c.kb) ELSE w.es END,
         CASE WHEN ok AND c.kc IS NOT NULL THEN list_append(w.ds, c.kc) ELSE w.ds END,
         CASE WHEN ok THEN list_append(w.acc, c.seq) ELSE w.acc END
  FROM walk w JOIN cand c ON c.rn = w.rn + 1,
       LATERAL (SELECT NOT (COALESCE(list_contains(w.us, c.ka), FALSE) OR COALESCE(list_contains(w.es, c.kb), FALSE)
                            OR COALESCE(list_contains(w.ds, c.kc), FALSE)) AS ok)),
accepted AS (SELECT unnest(acc) AS seq FROM walk),
acc_rows AS (SELECT c.* FROM cand c JOIN accepted a ON c.seq = a.seq),
lost AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.seq = c.seq)),
hits AS (SELECT l.seq, a.seq AS aseq, 0 AS rk FROM lost l JOIN acc_rows a ON a.ka = l.ka
         UNION ALL SELECT l.seq, a.seq, 1 FROM lost l JOIN acc_rows a ON a.kb = l.kb
         UNION ALL SELECT l.seq, a.seq, 2 FROM lost l JOIN acc_rows a ON a.kc = l.kc),
lost_cf AS (SELECT seq, CASE arg_min(rk, aseq * 3 + rk) WHEN 0 THEN '{a}' WHEN 1 THEN '{b}'
                             ELSE '{c}' END AS cf
            FROM hits GROUP BY seq),
decided AS (
  SELECT r.seq, r.error, COALESCE(h.cf, lc.cf) AS conflict_field,
         CASE WHEN r.error IS NOT NULL THEN 'invalid'
              WHEN COALESCE(h.cf, lc.cf) IS NOT NULL THEN 'conflict' ELSE 'accepted' END AS status
  FROM {regs} r LEFT JOIN stored_hit h ON r.seq = h.seq LEFT JOIN lost_cf lc ON r.seq = lc.seq)"""
_USERS = _REPLAY.format(a="username", b="email", c="dni", id="id", regs="user_regs_v", stored="users_t")
_SELLERS = _REPLAY.format(a="correo", b="dni", c="konami_id", id="vendedor_id", regs="seller_regs_v",
                          stored="vendedores")
Q["q_register_batch"] = with_ctes(_USERS + """
SELECT d.seq, d.status, d.error, d.conflict_field,
       CASE WHEN d.status = 'accepted' THEN COALESCE(NULLIF(r.user_type, ''), 'cliente') END AS user_type
FROM decided d JOIN user_regs_v r ON d.seq = r.seq""", "users_t", "user_regs_v")
Q["q_register_sellers"] = with_ctes(_SELLERS + """
SELECT seq, status, error, conflict_field FROM decided""", "vendedores", "seller_regs_v")
Q["q_default_roles"] = with_ctes(_USERS + """
SELECT d.seq, COALESCE(NULLIF(r.user_type, ''), 'cliente') AS role
FROM decided d JOIN user_regs_v r ON d.seq = r.seq WHERE d.status = 'accepted'""", "users_t", "user_regs_v")
Q["q_append_rows"] = with_ctes(_USERS + """
SELECT * FROM users_t
UNION ALL
SELECT -1 - r.seq AS id, r.username, CAST(NULL AS VARCHAR) AS password_hash, r.email, r.dni,
       COALESCE(NULLIF(r.user_type, ''), 'cliente') AS user_type, TRUE AS is_active,
       TIMESTAMP '2002-01-01 00:00:00' AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM decided d JOIN user_regs_v r ON d.seq = r.seq WHERE d.status = 'accepted'""", "users_t", "user_regs_v")
# The rows that a guarded update returns; D15: one column replaced, the last request holds
Q["q_guarded_update_affected"] = with_ctes(f"""
WITH u AS ({_UPDATES})
SELECT i.inventario_id, i.vendedor_id, i.card_id, COALESCE(u.u_cantidad, i.cantidad) AS cantidad,
       COALESCE(u.u_precio, i.precio) AS precio
FROM inventario i JOIN u ON u.inventario_id = i.inventario_id AND u.vendedor_id = i.vendedor_id""", "inventario")
Q["q_guarded_update_rejected"] = with_ctes(f"""
WITH u AS ({_UPDATES})
SELECT u.inventario_id, u.vendedor_id FROM u
WHERE NOT EXISTS (SELECT 1 FROM inventario i
                  WHERE u.inventario_id = i.inventario_id AND u.vendedor_id = i.vendedor_id)""", "inventario")
Q["q_replace_password"] = with_ctes("""
SELECT u.id, COALESCE(o.h, u.password_hash) AS password_hash
FROM users_t u LEFT JOIN (
  SELECT o_custkey AS id, 'new' || CAST(max(o_orderkey) AS VARCHAR) AS h FROM orders GROUP BY o_custkey) o
ON u.id = o.id""", "users_t")

# One-by-one replay as a recursive CTE over the attempts numbered per account
_WALK = """
WITH RECURSIVE ev AS (
  SELECT a.account_id, a."at", a.password_ok,
         row_number() OVER (PARTITION BY a.account_id ORDER BY a."at") AS rn
  FROM attempts_t a JOIN vendedores s ON a.account_id = s.vendedor_id WHERE s.activo),
walk AS (
  SELECT s.vendedor_id AS account_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS "at",
         CAST(NULL AS VARCHAR) AS outcome, s.intentos_fallidos AS n, s.bloqueado_hasta AS lk,
         CAST(NULL AS BIGINT) AS minutos, CAST(NULL AS INTEGER) AS restantes
  FROM vendedores s WHERE s.activo
  UNION ALL
  SELECT e.account_id, e.rn, e."at",
         CASE WHEN w.lk IS NOT NULL AND w.lk > e."at" THEN 'locked'
              WHEN NOT e.password_ok AND COALESCE(w.n, 0) + 1 >= 5 THEN 'locked_now'
              WHEN NOT e.password_ok THEN 'failed' ELSE 'ok' END,
         CASE WHEN w.lk IS NOT NULL AND w.lk > e."at" THEN w.n
              WHEN NOT e.password_ok THEN COALESCE(w.n, 0) + 1 ELSE 0 END,
         CASE WHEN w.lk IS NOT NULL AND w.lk > e."at" THEN w.lk
              WHEN NOT e.password_ok AND COALESCE(w.n, 0) + 1 >= 5 THEN e."at" + INTERVAL 1 DAY
              WHEN NOT e.password_ok THEN w.lk ELSE NULL END,
         CASE WHEN w.lk IS NOT NULL AND w.lk > e."at"
              THEN CAST(ceil((epoch_us(w.lk) - epoch_us(e."at")) / 60000000.0) AS BIGINT) END,
         CASE WHEN NOT (w.lk IS NOT NULL AND w.lk > e."at") AND NOT e.password_ok
                   AND COALESCE(w.n, 0) + 1 < 5 THEN CAST(5 - (COALESCE(w.n, 0) + 1) AS INTEGER) END
  FROM walk w JOIN ev e ON e.account_id = w.account_id AND e.rn = w.rn + 1)
"""

Q["q_login_lockout"] = with_ctes(_WALK + """
SELECT account_id, "at", outcome, n AS intentos_fallidos, lk AS bloqueado_hasta,
       minutos AS minutos_restantes, restantes AS intentos_restantes
FROM walk WHERE rn > 0
UNION ALL
SELECT a.account_id, a."at",
       CASE WHEN s.vendedor_id IS NULL THEN 'unknown'
            WHEN s.bloqueado_hasta IS NOT NULL AND s.bloqueado_hasta > a."at" THEN 'locked'
            ELSE 'inactive' END,
       s.intentos_fallidos, s.bloqueado_hasta,
       CASE WHEN s.vendedor_id IS NOT NULL AND s.bloqueado_hasta IS NOT NULL AND s.bloqueado_hasta > a."at"
            THEN CAST(ceil((epoch_us(s.bloqueado_hasta) - epoch_us(a."at")) / 60000000.0) AS BIGINT) END,
       CAST(NULL AS INTEGER)
FROM attempts_t a LEFT JOIN vendedores s ON a.account_id = s.vendedor_id
WHERE s.vendedor_id IS NULL OR NOT s.activo""", "attempts_t", "vendedores")

Q["q_login_lockout_sellers"] = with_ctes(_WALK + """
SELECT s.vendedor_id, w.n AS intentos_fallidos, w.lk AS bloqueado_hasta,
       COALESCE((SELECT max(o."at") FROM walk o WHERE o.account_id = s.vendedor_id AND o.outcome = 'ok'),
                s.ultimo_login) AS ultimo_login
FROM vendedores s JOIN walk w ON w.account_id = s.vendedor_id
 AND w.rn = (SELECT max(x.rn) FROM walk x WHERE x.account_id = s.vendedor_id)
UNION ALL
SELECT vendedor_id, intentos_fallidos, bloqueado_hasta, ultimo_login FROM vendedores WHERE NOT activo""",
                                          "attempts_t", "vendedores")

# micro-batches in arrival order give what one batch gives
Q["q_inventory_log"] = Q["q_bulk_upsert"]

_cte("search_reqs", """
SELECT k AS request_id, CASE WHEN k = 24 THEN '  ' WHEN k % 6 = 0 THEN upper(substr(p_name, 2, 4))
            WHEN k % 6 = 1 THEN substr(p_name, 1, 2) WHEN k % 6 = 2 THEN replace(substr(p_name, 1, 5), 'e', '_')
            WHEN k % 6 = 3 THEN substr(p_name, 1, 2) || '%' || right(p_name, 2)
            WHEN k % 6 = 4 THEN substr(p_name, 3, 1) ELSE p_name END AS text,
       CASE WHEN k % 3 = 1 THEN 'R' WHEN k % 3 = 2 THEN '' END AS condicion,
       CASE WHEN k % 4 = 1 THEN 'F' END AS idioma, CASE WHEN k % 5 <> 2 THEN (k + 1) * 4000.0 END AS precio_max
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) JOIN part ON p_partkey = 3 * k + 1""")

Q["q_search_many_cards"] = with_ctes("""
SELECT r.request_id, c.id FROM search_reqs r JOIN cards c ON c.name ILIKE '%' || r.text || '%' ESCAPE '\\'
WHERE trim(r.text) <> ''""", "search_reqs", "cards")

Q["q_search_many_sellers"] = with_ctes("""
SELECT k AS request_id, s.vendedor_id
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, '%' || CASE WHEN n_nationkey % 3 = 0 THEN 'kid' || n_nationkey
             WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey AS VARCHAR) ELSE 'NATION_' || n_nationkey END || '%' AS p
      FROM nation) r
JOIN vendedores s ON s.nombres ILIKE p OR s.apellidos ILIKE p OR s.konami_id ILIKE p
WHERE s.activo""", "vendedores")

Q["q_offers_many"] = with_ctes("""
SELECT r.request_id, d.inventario_id, d.vendedor_id, d.card_id, d.precio
FROM search_reqs r JOIN detail d ON d.card_name ILIKE '%' || r.text || '%' ESCAPE '\\'
WHERE trim(r.text) <> '' AND (COALESCE(r.condicion, '') = '' OR d.condicion = r.condicion)
  AND (COALESCE(r.idioma, '') = '' OR d.idioma = r.idioma)
  AND (r.precio_max IS NULL OR CAST(d.precio AS DOUBLE) <= r.precio_max)""", "search_reqs", "detail")

Q["q_login_check"] = with_ctes("""
WITH logins AS (SELECT email AS login FROM user_regs UNION SELECT username FROM users_t)
SELECT DISTINCT l.login, u.id, u.username, u.email, u.user_type,
       CASE WHEN u.is_active THEN 'ok' ELSE 'inactive' END AS status,
       CASE WHEN u.is_active THEN COALESCE(r.roles, '') ELSE '' END AS roles
FROM logins l JOIN users_t u ON l.login = u.username OR l.login = u.email
LEFT JOIN (SELECT user_id, string_agg(role, ',' ORDER BY role) AS roles FROM roles_t GROUP BY user_id) r
  ON r.user_id = u.id""", "user_regs", "users_t", "roles_t")

Q["q_card_offers_nested"] = with_ctes("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY precio ASC NULLS LAST, inventario_id) AS line_no,
                  count(*) OVER (PARTITION BY card_id) AS total FROM detail)
SELECT card_id, CAST((line_no - 1) // 50 AS BIGINT) AS page, max(card_name) AS name, max(total) AS total,
       string_agg(CAST(line_no AS VARCHAR) || ':' || CAST(inventario_id AS VARCHAR) || ':'
                  || COALESCE(CAST(precio AS VARCHAR), '~'), ',' ORDER BY line_no) AS items
FROM n GROUP BY card_id, (line_no - 1) // 50""", "detail")

Q["q_nest_banlist_last"] = """
SELECT l_partkey AS card_id, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS ban_ocg
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey
                           ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC,
                                    l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
                                    l_linestatus DESC) = 1"""

_cte("bulk_items", """
SELECT o_orderkey AS req, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                             l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS pos,
       o_custkey AS vendedor_id,
       CASE WHEN l_quantity = 25 THEN 0 WHEN l_linenumber % 4 <> 0 THEN l_partkey END AS card_id,
       CASE WHEN l_quantity <> 50 THEN CAST(l_quantity AS BIGINT) ELSE 1 END AS cantidad,
       NULLIF(CAST(l_extendedprice AS DECIMAL(12,2)), 0) AS precio, NULLIF(l_returnflag, '') AS condicion,
       NULLIF(l_linestatus, '') AS edicion
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 1""")

Q["q_bulk_requests"] = with_ctes("""
WITH n AS (SELECT vendedor_id, card_id, sum(cantidad) AS cantidad,
                  arg_min({'p': precio, 'c': COALESCE(condicion, 'Near Mint'), 'e': edicion}, {'r': req, 'p': pos}) AS f
           FROM bulk_items WHERE card_id <> 0 GROUP BY vendedor_id, card_id)
SELECT n.vendedor_id, n.card_id, CAST(CASE WHEN b.card_id IS NULL THEN n.cantidad ELSE b.cantidad + n.cantidad END AS BIGINT) AS cantidad,
       CASE WHEN b.card_id IS NULL THEN n.f.p ELSE b.precio END AS precio,
       CASE WHEN b.card_id IS NULL THEN n.f.c ELSE b.condicion END AS condicion,
       CASE WHEN b.card_id IS NULL THEN 'Inglés' ELSE b.idioma END AS idioma,
       CASE WHEN b.card_id IS NULL THEN n.f.e ELSE b.edicion END AS edicion
FROM n LEFT JOIN inventario b ON b.vendedor_id = n.vendedor_id AND b.card_id = n.card_id""", "bulk_items", "inventario")

Q["q_bulk_requests_rejected"] = with_ctes("""
SELECT o_orderkey AS seq, CAST(NULL AS INTEGER) AS line, o_custkey AS vendedor_id, 'empty or missing array' AS reason
FROM orders WHERE o_orderkey % 10 = 1 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL
SELECT req, CAST(pos AS INTEGER), vendedor_id, 'missing card_id' FROM bulk_items WHERE card_id IS NULL OR card_id = 0""",
                                           "bulk_items")

Q["q_array_casts"] = """
SELECT o_orderkey, CAST(z.a AS BIGINT) AS card_id, CAST(trim(z.b) AS DECIMAL(12,2)) AS price, CAST(z.c AS INTEGER) AS level
FROM (SELECT o_orderkey, unnest([CAST(o_orderkey AS VARCHAR), '12', NULL]) AS a,
             unnest([CAST(o_custkey AS VARCHAR) || '.25', NULL, ' 7.5 ']) AS b,
             unnest([CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 100 AS VARCHAR) END, NULL, NULL]) AS c
      FROM orders) z"""


def oracle_queries() -> dict[str, str]:
    return dict(Q)
