"""SQL for DuckDB that gives the rows of each query, written apart from the DataFrame plans."""

from __future__ import annotations

from . import queries as Q

SQL: dict[str, str] = {}

VOX = """vox AS (SELECT (vec_id%10)*4+(i&3) AS x, ((vec_id//10)%10)*4+((i>>2)&3) AS y, (vec_id//100)*4+(i>>4) AS z, label,
  trunc(least(greatest((e::double+1)*127.5,0),255))::int AS v
  FROM (SELECT vec_id, label, unnest(range(0,64)) AS i, unnest(embedding) AS e FROM embeddings))"""
LVL = VOX + """, lvl AS (SELECT l AS level, x>>l AS x, y>>l AS y, z>>l AS z, v FROM vox, range(0,4) t(l)
  WHERE x%(1<<l)=0 AND y%(1<<l)=0 AND z%(1<<l)=0 AND NOT (l=0 AND label<=2) AND NOT (l=1 AND label=0))"""
PTS = """pts AS (SELECT event_id, (event_id*7)%39+value%1.0 AS px, (user_id*5)%39+(value*3)%1.0 AS py, (event_id*3)%19+(value*7)%1.0 AS pz FROM events)"""
VERT = """vert0 AS (SELECT i, (i%21)/20.0::double AS u, (i//21)/20.0::double AS v, 1+(i%21)*1.85::double AS x, 1+(i//21)*1.85::double AS y,
  9.5::double+(((i%21)*7+(i//21)*3)%11-5)::double*0.5::double AS z, ((i//21)%3)::double-1 AS b, ((i%21)%3)::double-1 AS a FROM range(0,441) t(i)),
vert AS (SELECT i,u,v,x,y,z, a/sqrt(a*a+b*b+16) AS nx, b/sqrt(a*a+b*b+16) AS ny, 4.0::double/sqrt(a*a+b*b+16) AS nz FROM vert0)"""
FACE = """face AS (SELECT f, r*21+c+h AS v1, CASE WHEN h=0 THEN r*21+c+1 ELSE (r+1)*21+c+1 END AS v2, (r+1)*21+c AS v3
  FROM (SELECT f, f%2 AS h, (f//2)//20 AS r, (f//2)%20 AS c FROM range(0,800) t(f)))"""
_COLS = ", ".join(f"p{k}.{c} AS {'t' if c in 'uv' else ''}{c}{k}" for k in (1, 2, 3) for c in ("u", "v", "x", "y", "z", "nx", "ny", "nz"))
TRI = f"{VERT}, {FACE}, tri AS (SELECT f, {_COLS} FROM face JOIN vert p1 ON p1.i=v1 JOIN vert p2 ON p2.i=v2 JOIN vert p3 ON p3.i=v3)"


def i32(x: str) -> str:
    return f"trunc(least(greatest({x},-2147483648),2147483647))::bigint"


def idx(x: str) -> str:
    return f"trunc(greatest({x},0))::bigint"


def u8(x: str) -> str:
    return f"trunc(least(greatest({x},0),255))::int"


def add(name: str, body: str, *ctes: str) -> None:
    SQL[name] = ("WITH RECURSIVE " + ", ".join(ctes) + "\n" if ctes else "") + body


def lerp(c: list[str], x: str, y: str, z: str) -> str:
    one = lambda a, b, t: f"(({a})*(1-{t})+({b})*{t})"
    lo = one(one(c[0], c[1], x), one(c[2], c[3], x), y)
    hi = one(one(c[4], c[5], x), one(c[6], c[7], x), y)
    return one(lo, hi, z)


def corners(points: str, vox: str, key: str, extra: str = "") -> str:
    """A CTE `piv` with c0..c7 and n of each point (key, px, py, pz)."""
    pick = ", ".join(f"max(CASE WHEN k={k} THEN v END) AS c{k}" for k in range(8))
    return f"""asked AS (SELECT {key}{extra}, k, {idx('px')}+(k&1) AS x, {idx('py')}+((k>>1)&1) AS y, {idx('pz')}+(k>>2) AS z FROM {points}, range(0,8) t(k)),
piv AS (SELECT {key}{extra}, count(v) AS n, {pick} FROM asked LEFT JOIN {vox} USING ({'level, ' if extra else ''}x,y,z) GROUP BY ALL)"""


def blended(strict: bool) -> str:
    c = [f"coalesce(c{k},0)::double" for k in range(8)]
    v = u8(lerp(c, "(px-trunc(px))", "(py-trunc(py))", "(pz-trunc(pz))"))
    return f"CASE WHEN n=8 THEN {v} END" if strict else v


add("voxel_decode", "SELECT x, y, z, v FROM vox", VOX)
SQL["voxel_decode_chunks"] = SQL["voxel_decode"]
NEAREST = f"SELECT event_id, coalesce(v,0) AS v FROM pts LEFT JOIN vox ON x={idx('px')} AND y={idx('py')} AND z={idx('pz')}"
add("sample_nearest", NEAREST, VOX, PTS)
SQL["sample_nearest_chunks"] = SQL["sample_nearest"]
add("sample_trilinear", f"SELECT event_id, {blended(False)} AS v FROM pts JOIN piv USING (event_id)", VOX, PTS, corners("pts", "vox", "event_id"))
SQL["sample_trilinear_chunks"] = SQL["sample_trilinear"]
add("sample_trilinear_strict", f"SELECT event_id, {blended(True)} AS v FROM pts JOIN piv USING (event_id)", LVL, "l0 AS (SELECT x,y,z,v FROM lvl WHERE level=0)", PTS, corners("pts", "l0", "event_id"))
_each = " ".join(f"LEFT JOIN lvl l{s} ON l{s}.level={s} AND l{s}.x={idx('px')}>>{s} AND l{s}.y={idx('py')}>>{s} AND l{s}.z={idx('pz')}>>{s}" for s in range(4))
add("sample_pyramid", f"SELECT event_id, coalesce(l0.v,l1.v,l2.v,l3.v,0) AS v FROM pts {_each}", LVL, PTS)
add(
    "sample_pyramid_trilinear",
    f"SELECT event_id, coalesce(min_by(w, level) FILTER (w IS NOT NULL), 0) AS v FROM (SELECT event_id, level, {blended(True)} AS w FROM sp JOIN piv USING (event_id, level)) GROUP BY event_id",
    LVL, PTS, "sp AS (SELECT event_id, l AS level, px/(1<<l)::double AS px, py/(1<<l)::double AS py, pz/(1<<l)::double AS pz FROM pts, range(0,4) t(l))", corners("sp", "lvl", "event_id", ", level"),
)
SQL["sample_chunk_pyramid"] = SQL["sample_pyramid"]
SQL["sample_chunk_pyramid_trilinear"] = SQL["sample_pyramid_trilinear"]
add("volume_bounds", "SELECT event_id, px>=0 AND px<30 AND py>=0 AND py<30 AND pz>=0 AND pz<15 AS inside FROM pts", PTS)
add("tile_lookup", "SELECT event_id, CASE WHEN n IS NULL THEN 'Missing' ELSE 'Loaded' END AS state, coalesce(n,0) AS n FROM pts LEFT JOIN (SELECT x//4 AS cx, y//4 AS cy, z//4 AS cz, count(*) AS n FROM vox WHERE label<5 GROUP BY ALL) ON cx=floor(px)::bigint//4 AND cy=floor(py)::bigint//4 AND cz=floor(pz)::bigint//4", VOX, PTS)


def pane(a: str, b: str, c: str, zoom: int = 1, join: str = "JOIN", where: str = "WHERE v<>0", v: str = "v") -> str:
    at = {"x": 20, "y": 20, "z": 10}
    return f"SELECT px, py, {v} AS v FROM range(0,32) s(px), range(0,32) t(py) {join} vox ON {a}={at[a]}+(px-16)*{zoom} AND {b}={at[b]}+(py-16)*{zoom} AND {c}={at[c]} {where}"


SQL["slice_xy"] = f"WITH {VOX}\n" + pane("x", "y", "z")
SQL["slice_xz"] = f"WITH {VOX}\n" + pane("x", "z", "y")
SQL["slice_yz"] = f"WITH {VOX}\n" + pane("z", "y", "x")
SQL["slice_zoomed"] = f"WITH {VOX}\n" + pane("x", "y", "z", 2)
SQL["slice_generic"] = f"WITH {VOX}\n" + f"SELECT px, py, coalesce(v,0) AS v FROM (SELECT px, py, {idx('(20+px-16)')} AS x, {idx('(20+py-16)')} AS y, 10 AS z FROM range(0,32) s(px), range(0,32) t(py)) LEFT JOIN vox USING (x,y,z)"
_each = " ".join(f"LEFT JOIN lvl l{s} ON l{s}.v<>0 AND l{s}.level={s} AND l{s}.x=ax>>{s} AND l{s}.y=ay>>{s} AND l{s}.z=10>>{s}" for s in range(4))
add("slice_multires", f"SELECT * FROM (SELECT px, py, coalesce(l0.v,l1.v,l2.v,l3.v) AS v FROM (SELECT px, py, 20+px-16 AS ax, 20+py-16 AS ay FROM range(0,32) s(px), range(0,32) t(py)) {_each} WHERE ax>=0 AND ay>=0) WHERE v IS NOT NULL", LVL)
VIEWS = PTS + """, views AS (SELECT event_id, (floor(px)*64)::double AS u, (floor(py)*64)::double AS v, pow(2.0::double,(event_id%7-4)::double)*(CASE WHEN event_id%3=0 THEN 0.75::double ELSE 1.0::double END) AS zoom FROM pts),
zoomed AS (SELECT *, CASE WHEN zoom>=1 THEN 1 ELSE least(greatest(ceil(1.0/zoom)::int,1),32) END AS pz FROM views)"""
add("view_tiles", """SELECT event_id, ((y1-y0+1)*(x1-x0+1))::bigint AS n, x0::bigint AS min_x, x1::bigint AS max_x, y0::bigint AS min_y, y1::bigint AS max_y FROM
 (SELECT event_id, floor((u-800.0/zoom/2)/(256*pz))-1 AS x0, ceil((u+800.0/zoom/2)/(256*pz)) AS x1, floor((v-600.0/zoom/2)/(256*pz))-1 AS y0, ceil((v+600.0/zoom/2)/(256*pz)) AS y1 FROM zoomed)""", VIEWS)  # fmt: skip
add("zoom_levels", "SELECT event_id, pz AS paint_zoom, least(CASE WHEN floor(1.0/zoom)<1 THEN 0 ELSE floor(log2(floor(1.0/zoom)))::int+1 END,4) AS level, (log2(((event_id%16+1)&(-(event_id%16+1)))::double))::int AS scale FROM zoomed", VIEWS)
_rect = ", ".join(f"round({h}+(({t}+{m})*256*pz-{c})*zoom,6) AS \"{n}\"" for n, t, m, c, h in (("left", "tx", 0, "u", 400), ("top", "ty", 0, "v", 300), ("right", "tx", 1, "u", 400), ("bottom", "ty", 1, "v", 300)))
add("tile_rects", f"SELECT event_id, {_rect}, trunc((tx+0.5)*256*pz)::int AS cu, trunc((ty+0.5)*256*pz)::int AS cv FROM (SELECT *, event_id%5 AS tx, event_id%3 AS ty FROM zoomed)", VIEWS)
add("paint_alignment", "SELECT event_id, (n//4)*4 AS down, ((n+3)//4)*4 AS up FROM (SELECT event_id, event_id%101-50 AS n FROM events)")
add("pane_axes", "SELECT * FROM (VALUES ('XY',0,1,2),('XZ',0,2,1),('YZ',2,1,0),('UV',0,1,2)) t(pane,u,v,plane)")
add("contrast_filter", "SELECT x,y,z, least(255, greatest(0,v-70)*255//(255-130))::int AS v FROM vox", VOX)
add("bitmask_quant", f"SELECT x,y,z,mask, {u8('(v&mask)::double/mask::double*255.0')} AS v, z%2=0 AND (x%3>0 OR x%10<8 OR y%4>0) AS active FROM (SELECT *, ((CASE WHEN x%10 BETWEEN 1 AND 7 THEN (255<<(8-(x%10)::int))&255 ELSE 255 END) >> (y%4)::int)::int AS mask FROM vox)", VOX)
add("color_four", "SELECT x,y,z, CASE WHEN c IN (1,3) THEN 255 ELSE 0 END AS r, CASE WHEN c IN (2,3) THEN 255 ELSE 0 END AS g, CASE WHEN c IN (1,2,3) THEN 0 ELSE 255 END AS b FROM (SELECT *, v%6 AS c FROM vox)", VOX)
_hsb = {"r": ("b", "m", "0", "0", "m", "b"), "g": ("m", "b", "b", "m", "0", "0"), "b": ("0", "0", "m", "b", "b", "m")}
add("color_hsb", "SELECT x,y,z, " + ", ".join(f"floor((CASE sx {' '.join(f'WHEN {i} THEN {p}' for i, p in enumerate(c))} END)*255.0::double+0.5)::int AS {n}" for n, c in _hsb.items()) + """ FROM
 (SELECT *, floor(h/60)::int AS sx, b*(1-abs((h/60)%2-1)) AS m FROM (SELECT x,y,z, ((v%60)//2)::double/30.0*360.0 AS h, ((v%60)%2)::double/2+0.5 AS b FROM vox))""", VOX)  # fmt: skip
add("high_byte", "SELECT l_orderkey, l_linenumber, raw, raw>>8 AS v FROM (SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::int%65536 AS raw FROM lineitem)")

_m = [[f"{v!r}::double" for v in row] for row in Q.AFFINE]
_pos = {c: f"{m[0]}*x+{m[1]}*y+{m[2]}*z+{m[3]}" for c, m in zip("xyz", _m, strict=True)}
_nrm = {c: f"{m[0]}*nx+{m[1]}*ny+{m[2]}*nz" for c, m in zip("xyz", _m, strict=True)}
MOVED = f"{VERT}, m0 AS (SELECT i, {', '.join(f'{e} AS {c}' for c, e in _pos.items())}, {', '.join(f'{e} AS n{c}' for c, e in _nrm.items())} FROM vert), moved AS (SELECT i,x,y,z, nx/sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny/sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz/sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM m0)"
add("affine_apply", "SELECT i, " + ", ".join(f"round({c},6) AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz")) + " FROM moved", MOVED)
add("affine_inverse_roundtrip", "SELECT i, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z FROM vert", VERT)
# the inverse of this matrix, worked out by hand: determinant 0.5*(1-0.0625) + 0.25*0.5
_det = "(0.5::double*(0.5*2.0-0.125*0.5)-0.25*(-0.25*2.0))"
add("affine_inverse", f"""SELECT row, round(a,6) AS a, round(b,6) AS b, round(c,6) AS c, round(-(a*3.0+b*1.0+c*(-4.0)),6) AS d FROM
 (SELECT 0 AS row, (0.5*2.0-0.125*0.5)/{_det} AS a, -(0.25*2.0)/{_det} AS b, (0.25*0.125)/{_det} AS c
  UNION ALL SELECT 1, 0.5/{_det}, 1.0/{_det}, -(0.5*0.125)/{_det} UNION ALL SELECT 2, -0.125/{_det}, -0.25/{_det}, (0.25+0.0625)/{_det})""")  # fmt: skip
add("normals_transform", "SELECT i, round(sqrt(nx*nx+ny*ny+nz*nz),6) AS length, round(nx,6) AS nx FROM moved", MOVED)
add("uv_normalise", "SELECT i, round((u-(SELECT min(u) FROM w))/((SELECT max(u) FROM w)-(SELECT min(u) FROM w)),6) AS u, round((v-(SELECT min(v) FROM w))/((SELECT max(v) FROM w)-(SELECT min(v) FROM w)),6) AS v FROM w", VERT, "w AS (SELECT i, u*3.0-1.0 AS u, v*0.5+7.0 AS v FROM vert)")
add("ortho_xz", "SELECT i, round((x-min(x) OVER ())/(max(x) OVER ()-min(x) OVER ()),6) AS u, round((z-min(z) OVER ())/(max(z) OVER ()-min(z) OVER ()),6) AS v, 0.0::double AS nx, 1.0::double AS ny, 0.0::double AS nz FROM vert", VERT)


def edge(a: str, b: str, p: str = "q") -> str:
    """The edge function of corners a and b (numbers) at the pixel (qu, qv)."""
    return f"((u{b}-u{a})*({p}v-v{a})-(v{b}-v{a})*({p}u-u{a}))"


W = [edge("2", "3"), edge("3", "1"), edge("1", "2")]
INSIDE = f"{W[0]}>=0 AND {W[1]}>=0 AND {W[2]}>=0"


def pixel_corners(width: int = 120, height: int = 120, v: str = "{}") -> str:
    return ", ".join(f"{i32(f'tu{k}*{width}.0::double')} AS u{k}, {i32(v.format(f'tv{k}') + f'*{height}.0::double')} AS v{k}" for k in (1, 2, 3))


_wind = lambda v: f"(SELECT {INSIDE} FROM (SELECT *, (u1+u2+u3)//3 AS qu, (v1+v2+v3)//3 AS qv FROM (SELECT {pixel_corners(100000, 100000, v)} FROM tri WHERE f=1)))"
add("winding", f"SELECT 'plain' AS mesh, {_wind('{}')} AS winding UNION ALL SELECT 'flipped', {_wind('(1.0-{})')}", TRI)
LOW = lambda a: f"least({a}1,{a}2,{a}3)"
HIGH = lambda a: f"greatest({a}1,{a}2,{a}3)"
add("mesh_bounds", "SELECT f, " + ", ".join(f"{LOW(a)} AS min_{a}, {HIGH(a)} AS max_{a}" for a in "xyz") + " FROM tri", TRI)
add("mesh_wide", "SELECT f, " + ", ".join(f"round({c}{k},6) AS {c}{k}" for k in (1, 2, 3) for c in ("tu", "tv", "x", "y", "z")) + " FROM tri", TRI)
add("uv_bin_join", f"SELECT event_id, f FROM (SELECT event_id, px/40 AS lu, py/40 AS lv FROM pts), tri WHERE {LOW('tu')}<=lu+0.03 AND {HIGH('tu')}>=lu AND {LOW('tv')}<=lv+0.02 AND {HIGH('tv')}>=lv", PTS, TRI)
add("xyz_bin_join", "SELECT event_id, f FROM pts, tri WHERE " + " AND ".join(f"{LOW(a)}<=p{a}+1.5 AND {HIGH(a)}>=p{a}" for a in "xyz"), PTS, TRI)

_w = lambda k: f"w{k}::double"
_mix = lambda c: f"({_w(0)}*{c}1+{_w(1)}*{c}2+{_w(2)}*{c}3)*(1.0/(w0+w1+w2)::double) AS {c}"


def raster(name: str = "frag", low: tuple[int, int] = (0, 0), size: tuple[int, int] = (120, 120), zoom: int = 1) -> str:
    """CTEs: `frag` with every pixel under every face of the window, and its painting order."""
    span = lambda a, k: f"q{a} BETWEEN greatest((({LOW(a)}-({low[k]}))//{zoom})*{zoom},0) AND least((({HIGH(a)}-({low[k]})+{zoom - 1})//{zoom})*{zoom},{size[k] * zoom - 1})"
    lim = [(low[k] / 120, (low[k] + size[k] // 2 * 2 * zoom) / 120) for k in (0, 1)]
    cell = lambda x: f"least({idx(f'({x})/0.5::double')},1)"
    vis = " AND ".join(f"{cell(LOW(a))}<={cell(f'{lim[k][1]!r}::double')} AND {cell(HIGH(a))}>={cell(f'{lim[k][0]!r}::double')} AND {LOW(a)}<={lim[k][1]!r} AND {HIGH(a)}>={lim[k][0]!r}" for k, a in enumerate(("tu", "tv")))
    order = ", ".join(f"least({cell(HIGH(a))},{cell(f'{lim[k][1]!r}::double')}) AS o{a}" for k, a in enumerate(("tu", "tv")))
    w = [e.replace("qu", f"(qu+({low[0]}))").replace("qv", f"(qv+({low[1]}))") for e in W]
    return f"""corner AS (SELECT *, {order}, {pixel_corners()} FROM tri WHERE {vis}),
hit AS (SELECT *, {w[0]} AS w0, {w[1]} AS w1, {w[2]} AS w2 FROM corner, (SELECT g*{zoom} AS qu FROM range(0,{size[0]}) a(g)), (SELECT g*{zoom} AS qv FROM range(0,{size[1]}) b(g)) WHERE {span('u', 0)} AND {span('v', 1)}),
{name} AS (SELECT qu//{zoom} AS px, qv//{zoom} AS py, f, otv*1000000+otu*100000+f AS ord, w0, w1, w2, {', '.join(map(_mix, ('x', 'y', 'z', 'nx', 'ny', 'nz')))} FROM hit WHERE w0>=0 AND w1>=0 AND w2>=0 AND w0+w1+w2>0)"""


TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY px,py ORDER BY ord DESC) AS rn FROM frag) WHERE rn=1)"
R6 = ", ".join(f"round({c},6)+0.0::double AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz"))
add("raster_pixels", f"SELECT px, py, f, w0, w1, w2, {R6} FROM frag", TRI, raster())
add("raster_zoomed", "SELECT px, py, f, round(x,6) AS x, round(y,6) AS y FROM top", TRI, raster(low=(70 - 60, 50 - 45), size=(40, 30), zoom=3), TOP)
_cellq = lambda x: f"least({idx(f'({x})*2.0::double')},1)"
_cellf = lambda x: f"least({idx(f'({x})/0.5::double')},1)"
_nw = lambda c: f"(CASE WHEN w=0 THEN 0.0::double ELSE n{c} END)"
add(
    "uv_to_xyz",
    "SELECT event_id, " + ", ".join(f"coalesce(b.{c},-1)::int AS {c}" for c in "xyz") + f" FROM q LEFT JOIN (SELECT event_id, {', '.join(f'min_by({i32(f'{c}+w::double*{_nw(c)}')}, f) AS {c}' for c in 'xyz')} FROM mixed GROUP BY event_id) b USING (event_id)",
    PTS, TRI, f"q AS (SELECT event_id, floor(px*3.2)::bigint AS qu, floor(py*3.2)::bigint AS qv, event_id%7-3 AS w FROM pts)", f"corner AS (SELECT *, {pixel_corners()} FROM tri)",
    f"hit AS (SELECT *, {W[0]} AS w0, {W[1]} AS w1, {W[2]} AS w2 FROM corner, q WHERE qu BETWEEN {LOW('u')} AND {HIGH('u')} AND qv BETWEEN {LOW('v')} AND {HIGH('v')} AND {_cellq('qu/120.0::double')} BETWEEN {_cellf(LOW('tu'))} AND {_cellf(HIGH('tu'))} AND {_cellq('qv/120.0::double')} BETWEEN {_cellf(LOW('tv'))} AND {_cellf(HIGH('tv'))})",
    f"mixed AS (SELECT event_id, f, w, {', '.join(map(_mix, ('x', 'y', 'z', 'nx', 'ny', 'nz')))} FROM hit WHERE w0>=0 AND w1>=0 AND w2>=0 AND w0+w1+w2>0)",
)
SQL["sync_target"] = f"SELECT event_id, x>=0 AND y>=0 AND z>=0 AS valid FROM ({SQL['uv_to_xyz']})"
_at = lambda w: ", ".join(f"{c}+{w}*n{c} AS p{c}" for c in "xyz")
_near = f"LEFT JOIN vox ON vox.x={idx('p.px_')} AND vox.y={idx('p.py_')} AND vox.z={idx('p.pz_')}"
_ray = lambda w: ", ".join(f"{c}+{w}*n{c} AS p{c}_" for c in "xyz")
add("surface_render", f"SELECT px, py, coalesce(v,0) AS v FROM (SELECT px, py, x AS px_, y AS py_, z AS pz_ FROM top) p {_near}", VOX, TRI, raster(), TOP)
add("surface_render_trilinear", f"SELECT at_x AS px, at_y AS py, {blended(False)} AS v FROM tp JOIN piv USING (pixel)", VOX, TRI, raster(), TOP, f"tp AS (SELECT py*120+px AS pixel, px AS at_x, py AS at_y, x+1.0*nx AS px, y+1.0*ny AS py, z+1.0*nz AS pz FROM top)", corners("tp", "vox", "pixel"))
add("surface_outline", "SELECT px, py, CASE WHEN nx_ THEN 0 WHEN ny_ THEN 255 ELSE 0 END AS r, CASE WHEN nx_ THEN 0 WHEN ny_ THEN 0 ELSE 255 END AS g, CASE WHEN nx_ THEN 255 ELSE 0 END AS b FROM (SELECT *, abs(x-20.0)<2 AS nx_, abs(y-20.0)<2 AS ny_, abs(z-10.0)<2 AS nz_ FROM top) WHERE nx_ OR ny_ OR nz_", TRI, raster(), TOP)
RAYS = lambda steps: f"ray AS (SELECT p.px, p.py, k, coalesce(v,0) AS v FROM (SELECT px, py, k, {_ray('w::double')} FROM top, (SELECT unnest({steps}) AS w, unnest(range(0,{len(steps)})) AS k)) p {_near})"


def fold(how) -> str:
    """The alpha fold of a list `a` of doubles."""
    low, high, cut, op = f"({how.alpha_min}/255.0::double)", f"({how.alpha_max}/255.0::double)", f"({how.threshold}/10000.0::double)", f"({how.opacity}/100.0::double)"
    val = f"least(greatest((e.a/255.0::double-{low})/({high}-{low}),0.0),1.0)"
    wgt = f"((1.0-s.alpha)*least({val}*{op},1.0))"
    gain = f"{wgt}*{'s.depth' if how.mode == Q.composite.HEIGHT else val}"
    new = f"{{'a': 0.0::double, 'alpha': CASE WHEN {val}<>0 THEN s.alpha+{wgt} ELSE s.alpha END, 'value': CASE WHEN {val}<>0 THEN s.value+{gain} ELSE s.value END, 'depth': s.depth+1.0, 'done': {val}<>0 AND s.alpha+{wgt}>={cut}}}"
    state = f"list_reduce(l, lambda s, e: CASE WHEN s.done THEN s ELSE {new} END, {{'a': 0.0::double, 'alpha': 0.0::double, 'value': 0.0::double, 'depth': 0.0::double, 'done': false}})"
    done = u8("s.value*255.0") if how.mode == Q.composite.ALPHA else f"CASE WHEN s.alpha=0 THEN 0 ELSE {u8(f'255.0-s.value/s.alpha*255.0/{how.layers}.0')} END"
    rows = "SELECT px, py, list({'a': v::double, 'alpha': 0.0::double, 'value': 0.0::double, 'depth': 0.0::double, 'done': false} ORDER BY k) AS l FROM ray GROUP BY ALL"
    return f"SELECT px, py, {done} AS v FROM (SELECT px, py, {state} AS s FROM ({rows}))"


def composited(name: str, how) -> None:
    body = "SELECT px, py, max(v) AS v FROM ray GROUP BY ALL" if how.mode == Q.composite.MAX else fold(how)
    add(name, body, VOX, TRI, raster(), TOP, RAYS(how.steps()))


composited("composite_max", Q.composite.Composite(Q.composite.MAX))
composited("composite_alpha", Q.composite.Composite(Q.composite.ALPHA, opacity=200))
composited("composite_alpha_reverse", Q.composite.Composite(Q.composite.ALPHA, opacity=120, threshold=6000, reverse=True))
composited("composite_height", Q.composite.Composite(Q.composite.HEIGHT, opacity=100))


def segments(u: str, v: str, plane: str, at: float, centre: tuple[int, int]) -> str:
    low, high = [c - 20 for c in centre], [c + 20 for c in centre]
    near = " AND ".join(f"{LOW(a)}<={b} AND {HIGH(a)}>={c}" for a, c, b in ((u, low[0], high[0]), (v, low[1], high[1]), (plane, at, at)))
    pts = []
    for a, b in ((1, 2), (2, 3), (3, 1)):
        t = f"(({at}-{plane}{a})/(({at}-{plane}{a})-({at}-{plane}{b})))"
        pts.append(f"CASE WHEN ({plane}{a}-{at}>=0)<>({plane}{b}-{at}>=0) THEN {{'u': {u}{a}+{t}*({u}{b}-{u}{a}), 'v': {v}{a}+{t}*({v}{b}-{v}{a})}} END")
    mark = f"{LOW('tu')}<=0.6 AND {HIGH('tu')}>=0.2 AND {LOW('tv')}<=0.6 AND {HIGH('tv')}>=0.2"
    return f"seg AS (SELECT f, p[1].u AS u0, p[1].v AS v0, p[2].u AS u1, p[2].v AS v1, highlighted FROM (SELECT f, list_filter([{', '.join(pts)}], lambda q: q IS NOT NULL) AS p, {mark} AS highlighted FROM tri WHERE {near}) WHERE len(p)=2)"


SEG = segments("x", "y", "z", 10.0, (20, 20))
_r = "round(u0,6) AS u0, round(v0,6) AS v0, round(u1,6) AS u1, round(v1,6) AS v1"
add("plane_mesh_segments", f"SELECT f, {_r}, highlighted FROM seg", TRI, SEG)
add("plane_mesh_segments_xz", f"SELECT f, {_r} FROM seg", TRI, segments("x", "z", "y", 17.0, (20, 10)))
ENDS = f"ends AS (SELECT f, highlighted, {i32('u0-0.0')} AS x0, {i32('v0-0.0')} AS y0, {i32('u1-0.0')} AS x1, {i32('v1-0.0')} AS y1 FROM seg)"
add(
    "plane_mesh_raster",
    "SELECT px, py, 255 AS r, CASE WHEN h THEN 170 ELSE 0 END AS g, CASE WHEN h THEN 0 ELSE 255 END AS b FROM (SELECT x AS px, y AS py, max_by(highlighted, f) AS h FROM line WHERE NOT (x=x1 AND y=y1) AND x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 39 GROUP BY ALL)",
    TRI, SEG, ENDS,
    """line AS (SELECT f, highlighted, x1, y1, x0 AS x, y0 AS y, abs(x1-x0) AS dx, -abs(y1-y0) AS dy, CASE WHEN x0<x1 THEN 1 ELSE -1 END AS sx, CASE WHEN y0<y1 THEN 1 ELSE -1 END AS sy, abs(x1-x0)-abs(y1-y0) AS e FROM ends
 UNION ALL SELECT f, highlighted, x1, y1, x+CASE WHEN 2*e>=dy THEN sx ELSE 0 END, y+CASE WHEN 2*e<=dx THEN sy ELSE 0 END, dx, dy, sx, sy, e+CASE WHEN 2*e>=dy THEN dy ELSE 0 END+CASE WHEN 2*e<=dx THEN dx ELSE 0 END FROM line WHERE NOT (x=x1 AND y=y1))""",
)
add("vertex_markers", "SELECT DISTINCT x+i AS px, y+j AS py FROM (SELECT x0 AS x, y0 AS y FROM ends UNION ALL SELECT x1, y1 FROM ends), range(-2,2) a(i), range(-2,2) b(j) WHERE x+i BETWEEN 0 AND 39 AND y+j BETWEEN 0 AND 39", TRI, SEG, ENDS)

MAP = "map0 AS (SELECT n%40 AS u, n//40 AS v FROM range(0,1600) t(n)), map AS (SELECT u, v, " + ", ".join(f"CASE WHEN (u+v)%17=0 THEN 0.0::double ELSE {e} END AS {c}" for c, e in (("x", "u+0.25::double"), ("y", "v+0.5::double"), ("z", "((u*3+v)%5)*0.5::double+9.0"), ("nx", "0.125::double"), ("ny", "0.25::double"), ("nz", "0.875::double"))) + " FROM map0)"
MQ = f"mq AS (SELECT event_id, px AS mu, py AS mv, trunc(px)::bigint AS u, trunc(py)::bigint AS v, (event_id%11-5)*(CASE WHEN event_id%50=0 THEN 10 ELSE 1 END) AS w FROM pts), ok AS (SELECT * FROM mq WHERE u>0 AND u<40 AND v>0 AND v<40 AND abs(w)<=45)"
_ppm = f"SELECT event_id, coalesce(g.v,0) AS v FROM pts LEFT JOIN (SELECT event_id, vox.v FROM (SELECT event_id, {_ray('w::double')} FROM spot WHERE NOT (x=0 AND y=0 AND z=0)) p {_near}) g USING (event_id)"
add("ppm_sample", _ppm, VOX, PTS, MAP, MQ, "spot AS (SELECT event_id, w, x, y, z, nx, ny, nz FROM ok JOIN map USING (u,v))")
_bi = lambda c: f"coalesce(a.{c},0)*(1-du)*(1-dv)+coalesce(b.{c},0)*du*(1-dv)+coalesce(c.{c},0)*(1-du)*dv+coalesce(d.{c},0)*du*dv AS {c}"
add("ppm_bilinear", _ppm, VOX, PTS, MAP, MQ, "spot AS (SELECT event_id, w, " + ", ".join(map(_bi, ("x", "y", "z", "nx", "ny", "nz"))) + " FROM (SELECT *, mu-u AS du, mv-v AS dv FROM ok) o LEFT JOIN map a ON a.u=o.u AND a.v=o.v LEFT JOIN map b ON b.u=o.u+1 AND b.v=o.v LEFT JOIN map c ON c.u=o.u AND c.v=o.v+1 LEFT JOIN map d ON d.u=o.u+1 AND d.v=o.v+1)")

TILES = "tiles AS (SELECT u::int AS u, v::int AS v, w::int AS w FROM range(30,35) a(w), range(0,120,48) b(v), range(0,120,48) c(u))"
add("uv_tiles", "SELECT * FROM tiles", TILES)
add("tiles_per_layer", "SELECT w, count(*) AS n FROM tiles GROUP BY w", TILES)
DEMAND = f"""need AS (SELECT DISTINCT u, v, w, ({idx('pxx')}+dx)//4 AS cx, ({idx('pyy')}+dy)//4 AS cy, ({idx('pzz')}+dz)//4 AS cz
 FROM (SELECT (px//48)*48 AS u, (py//48)*48 AS v, w::int AS w, x+(w-32)::double*nx AS pxx, y+(w-32)::double*ny AS pyy, z+(w-32)::double*nz AS pzz FROM frag, range(30,35) t(w)), range(0,2) a(dx), range(0,2) b(dy), range(0,2) c(dz))"""
HAVE = "have AS (SELECT DISTINCT x//4 AS cx, y//4 AS cy, z//4 AS cz FROM vox WHERE label<5)"
add("chunk_demand", "SELECT u, v, w, cx, cy, cz FROM need", TRI, raster(), DEMAND)
add("chunk_missing", "SELECT DISTINCT cx, cy, cz FROM need EXCEPT SELECT * FROM have", VOX, TRI, raster(), DEMAND, HAVE)
add("chunk_union", "SELECT cx, cy, cz FROM need UNION SELECT * FROM have", VOX, TRI, raster(), DEMAND, HAVE)
add("layer_blit", f"SELECT w, px, py, coalesce(v,0) AS v FROM (SELECT w::int AS w, px, py, {_ray('w::double')} FROM top, (SELECT unnest([-1,0,1]) AS w)) p {_near}", VOX, TRI, raster(), TOP)

SQL["layer_blit_chunks"] = SQL["layer_blit"]

SEGS = "segs AS (SELECT doc_id AS segment_id, lang AS scroll_id, source AS num, doc_id%7=0 AS is_fragment, n_chars AS width FROM documents)"
add("catalog_group", "SELECT scroll_id, is_fragment, num, count(*) AS n, string_agg(segment_id::varchar, ',' ORDER BY segment_id) AS segments FROM segs GROUP BY ALL", SEGS)
add("catalog_sort", "SELECT scroll_id, is_fragment, num, (row_number() OVER (ORDER BY is_fragment, num, scroll_id))::int AS rank FROM (SELECT DISTINCT scroll_id, is_fragment, num FROM segs)", SEGS)
add("catalog_cached", "SELECT * FROM segs WHERE segment_id IN (SELECT doc_id FROM labels)", SEGS)
add("catalog_table", "SELECT segment_id, CASE WHEN is_fragment THEN 'Fragment ' ELSE 'Scroll ' END || num || ' - ' || scroll_id AS label, CASE WHEN segment_id%5<>0 THEN printf('%.1f', width/1024.0::double) ELSE '' END AS area FROM segs", SEGS)
REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(str(v) for v in Q.VOLUMES) + ") t(id,label,format,location_kind,location))"
add("volume_lookup", "SELECT segment_id, num AS volume_id, label, format, location FROM segs LEFT JOIN reg ON id=num", SEGS, REG)
add("volume_list", "SELECT id || ' -> ' || label AS line FROM reg", REG)
add("volume_urls", "SELECT DISTINCT (x//4)::int AS cx, (y//4)::int AS cy, (z//4)::int AS cz, printf('64-4/d%02d/z%03d/xyz-%03d-%03d-%03d-b255-d%02d.bin', 1, z//4, x//4, y//4, z//4, 1) AS path FROM vox", VOX)
add("cache_hash", "SELECT page_id, sha256(regexp_replace(url,'/$','')) AS name FROM pages")
add("crop_parse", "SELECT event_id, " + ", ".join(f"CASE WHEN event_id%9<>0 THEN {e}::int END AS \"{n}\"" for n, e in (("left", "(event_id%100)"), ("top", "(user_id%50)"), ("width", "640"), ("height", "(event_id%480)"))) + ", CASE WHEN event_id%9<>0 THEN 640 ELSE 1000 END AS render_width FROM events")
add("cell_name_parse", "SELECT max(y)::int AS max_y, max(x)::int AS max_x, max(z)::int AS max_z, count(DISTINCT (y,x,z)) AS n_cells FROM (SELECT l_linenumber AS y, l_suppkey%30+1 AS x, l_partkey%20+1 AS z FROM lineitem)")
add("format_sniff", """SELECT v AS volume, CASE WHEN bool_or(k=0 AND v%4<>0) THEN 'ome' WHEN bool_or(k=1 AND v%3<>0) THEN 'zarr' WHEN bool_or(k=2) THEN 'cells' WHEN bool_or(k=3) THEN 'layers' END AS format
 FROM (SELECT doc_id%60 AS v, doc_id%6 AS k FROM documents) GROUP BY v""")  # fmt: skip
add("json_meta", "SELECT event_id, json_extract_string(props,'$.k')::bigint AS k, pos::int AS pos, pos::varchar AS path, 'lz4' AS codec, 32::bigint AS chunk, 25::bigint AS n_chunks FROM events, range(0,4) t(pos)")
CLASSED = "cls AS (SELECT x, y, z, v%7 AS v, (z*40+y)*40+x AS i FROM vox)"
_steps = " UNION ALL ".join(f"SELECT a.i AS a, b.i AS b FROM cls a JOIN cls b ON a.v=b.v AND b.x=a.x+{dx} AND b.y=a.y+{dy} AND b.z=a.z+{dz}" for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
REACH = f"""edges AS ({_steps}),
walk AS (SELECT i AS root, i AS node FROM cls UNION SELECT root, b FROM walk JOIN edges ON a=node WHERE b>root),
comp AS (SELECT node, min(root) AS component FROM walk GROUP BY node)"""
add("components_volume", "SELECT x, y, z, component FROM cls JOIN comp ON node=i", VOX, CLASSED, REACH)
add("component_sizes", "SELECT component, count(*) AS n FROM comp GROUP BY component HAVING count(*)>5", VOX, CLASSED, REACH)
add("component_numbers", """SELECT component, n, CASE WHEN n>5 THEN ((rank+2)%256)::int ELSE 1 END AS id
 FROM (SELECT *, row_number() OVER (PARTITION BY n>5 ORDER BY component) AS rank FROM (SELECT component, count(*) AS n FROM comp GROUP BY component))""", VOX, CLASSED, REACH)  # fmt: skip
add("point_cloud", "SELECT CASE WHEN v>=127 THEN 1 ELSE 2 END AS part, x, y, z FROM vox", VOX)
add("morton_index", """SELECT x, y, z, v, ((((z&7936)<<2)|((y&7936)>>3)|((x&7936)>>8))<<24) | ((((z&240)<<4)|(y&240)|((x&240)>>4))<<12) | (((z&15)<<8)|((y&15)<<4)|(x&15)) AS address
 FROM (SELECT x*203 AS x, y*203 AS y, z*97 AS z, v FROM vox)""", VOX)  # fmt: skip
add("value_sum", "SELECT sum(v)::bigint AS total, count(*) FILTER (v<>0) AS n_lit FROM vox", VOX)
add("cache_lru", "SELECT user_id, last FROM l WHERE last <= (SELECT quantile_disc(last, 0.2) FROM l)", "l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id)")
add("repeated_requests", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n=1 OR p IS DISTINCT FROM event_type")
add("last_writer", "SELECT floor(px)::bigint AS x, floor(py)::bigint AS y, max(event_id) AS last, min(event_id) AS first FROM pts GROUP BY ALL", PTS)
ARRIVED = """arrived AS (SELECT event_id%10 AS cx, (event_id//10)%10 AS cy, user_id%5 AS cz, ['Queuing','Downloading','Done','Failed','Delayed','Pruned'][(event_id%6+1)::int] AS state, ts FROM events),
latest AS (SELECT cx, cy, cz, max({'ts': ts, 'state': state}).state AS state, count(*) AS n_reports FROM arrived GROUP BY ALL)"""
add("download_states", "SELECT cx, cy, cz, state, n_reports, state IN ('Failed','Delayed','Pruned') AS reload FROM latest", ARRIVED)
add("chunk_arrivals", "SELECT cx, cy, cz, state, n_reports FROM latest", ARRIVED)
add("empty_volume", "SELECT event_id, 0 AS v FROM events")
add("overlay_slice", "SELECT px, py, v, label=3 AS overlaid FROM (SELECT px, py, v, label FROM range(0,32) s(px), range(0,32) t(py) JOIN vox ON x=20+px-16 AND y=20+py-16 AND z=10 WHERE v<>0)", VOX)
