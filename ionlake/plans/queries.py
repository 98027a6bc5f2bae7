"""The imaging queries over the spectral views, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.operators import convert, datasets, imaging, peaks, quantiles, regions, signal, spectra, stored, surfaces
from ionlake.operators.tables import numbered, own_folder
from ionlake.sources import images as image_files
from ionlake.plans.views import EM, EV, LI, MASK, checker_mask, pts_em, pts_ev, pts_li
from ionlake.plans.views import spectra as as_spectra

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MASSES = [105.0, 120.0, 150.0]
MANY = [100.5 + 2 * k for k in range(50)]
REFERENCES = [1000.0 * k for k in range(2, 60)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _image_sql(where: str, mass: str = "", joins: str = "") -> str:
    key = f"{mass}, " if mass else ""
    return f"s as (select {key}spectrum_id, x, y, max(intensity) i from p {joins} where {where} group by {key}spectrum_id, x, y), img as (select {key}x, y, arg_max(i, spectrum_id) intensity from s where i > 0 group by {key}x, y)"


IMAGE = _image_sql("mz between 105.0e0 and 115.0e0")
MASS_LIST = "masses as (select unnest([105.0e0, 120.0e0, 150.0e0]) mass)"
MULTI = MASS_LIST + ", " + _image_sql("mz between mass-5.0e0 and mass+5.0e0", "mass", ", masses")
MANY_SQL = "masses as (select 100.5e0+2*k mass from range(50) r(k)), " + _image_sql("mz between mass-0.1e0 and mass+0.1e0", "mass", ", masses")
ORD = "(partition by spectrum_id order by mz, pos"
STATS = """st as (select spectrum_id "SpectrumID", round(sum(intensity), 6) "TIC", max(intensity) "BPI", arg_max(mz, struct_pack(a:=intensity, b:=-mz, c:=-pos)) "BasePeakMZ",
 cast(count(*) as int) "NumPoints", min(mz) "MinMZ", max(mz) "MaxMZ", 'UNKNOWN' "Mode" from p group by spectrum_id)"""
NOISE = "nz as (with m as (select spectrum_id, median(intensity) m from p group by 1) select p.spectrum_id, median(abs(intensity-m))*1.4826022185e0 noise from p join m using (spectrum_id) group by 1)"
EPS = "2.220446049250313e-16"


@query(f"with {EV}, {IMAGE} select * from img")
def ion_image(spark, sf):
    return imaging.ion_image(pts_ev(spark, sf), 110.0, 5.0)


@query(f"with {EV}, {MASK}, {_image_sql('mz between 105.0e0 and 115.0e0 and (x+y)%3<>0')} select * from img")
def ion_image_masked(spark, sf):
    p = pts_ev(spark, sf)
    return imaging.ion_image(p, 110.0, 5.0, checker_mask(p))


@query(f"with {EV}, {MULTI} select * from img")
def ion_images_multi(spark, sf):
    return imaging.ion_images(pts_ev(spark, sf), MASSES, 5.0)


@query(f"with {EV}, {MANY_SQL} select * from img")
def ion_images_bucketed(spark, sf):
    return imaging.ion_images_bucketed(pts_ev(spark, sf), MANY, 0.1)


@query(f"with {EV}, {STATS} select * from st")
def spectrum_stats(spark, sf):
    return spectra.statistics(pts_ev(spark, sf))


@query(f"with {LI}, {STATS} select * from st")
def spectrum_stats_lineitem(spark, sf):
    return spectra.statistics(pts_li(spark, sf))


@query(f"with {EV} select min(mz) min_mz, max(mz) max_mz from p")
def global_mz_range(spark, sf):
    return spectra.mz_range(pts_ev(spark, sf))


def _total_sql(n: int, mean: bool, where: str = "") -> str:
    return f"""with {EV}, q as (select * from p {where}), r as (select min(mz) lo, max(mz) hi from p), c as (select count(distinct spectrum_id) n from q),
 b as (select cast(greatest(1, least({n}, floor((mz-lo)*({n - 1}/(hi-lo))+1))) as int) bin, sum(intensity) s from q, r group by 1),
 g as (select cast(k as int) bin from range(1, {n + 1}) t(k))
 select g.bin, round(lo+(g.bin-1)*((hi-lo)/{n - 1}), 6) mz, round(coalesce(s, 0)/{"c.n" if mean else "1"}, 6) intensity, c.n n_spectra from g left join b on g.bin=b.bin, r, c"""


@query(_total_sql(200, False))
def total_spectrum(spark, sf):
    return spectra.total_spectrum(pts_ev(spark, sf), 200)


@query(_total_sql(200, True))
def average_spectrum(spark, sf):
    return spectra.total_spectrum(pts_ev(spark, sf), 200, mean=True)


@query(_total_sql(200, False, "where (x+y)%3<>0"))
def total_spectrum_masked(spark, sf):
    p = pts_ev(spark, sf)
    return spectra.total_spectrum(imaging.masked(p, checker_mask(p)), 200, span=spectra.mz_range(p))


@query(f"with {EV} select pos, mz, intensity from p where spectrum_id=7")
def spectrum_by_index(spark, sf):
    return spectra.spectrum_at(pts_ev(spark, sf), 7)


@query(f"with {EV} select spectrum_id, pos, mz, intensity from p where x=4 and y=1 and spectrum_id=(select max(spectrum_id) from p where x=4 and y=1)")
def spectrum_by_xy(spark, sf):
    return spectra.spectrum_at_pixel(pts_ev(spark, sf), 4, 1)


@query(f"with {EV} select x, y, max(spectrum_id) spectrum_id from p group by 1, 2")
def coordinate_map(spark, sf):
    return spectra.coordinate_map(pts_ev(spark, sf))


@query(f"with {EV}, {MASK} select p.spectrum_id, p.x, p.y, count(*) n from p semi join mask using (x, y) group by 1, 2, 3")
def mask_semi(spark, sf):
    p = pts_ev(spark, sf)
    return imaging.masked(p, checker_mask(p)).groupBy("spectrum_id", "x", "y").agg(F.count("*").alias("n"))


@query(f"with {EV}, {MASK} select p.spectrum_id, p.x, p.y, count(*) n from p anti join mask using (x, y) group by 1, 2, 3")
def mask_anti(spark, sf):
    p = pts_ev(spark, sf)
    return imaging.outside(p, checker_mask(p)).groupBy("spectrum_id", "x", "y").agg(F.count("*").alias("n"))


@query(f"with {EV}, f as (select distinct spectrum_id from p order by 1 limit 10) select p.* from p semi join f using (spectrum_id)")
def subset_first_n(spark, sf):
    return spectra.first_n(pts_ev(spark, sf), 10)


@query(f"""with {EV}, w as (select *, min(mz) over s lo, max(mz) over s hi, count(*) over s c from p window s as (partition by spectrum_id)),
 t as (select spectrum_id, least(20, floor((mz-lo)/((hi-lo)/20))+1) bin, arg_max(struct_pack(m:=mz, i:=intensity), struct_pack(a:=intensity, b:=-mz, c:=-pos)) t from w where c>20 group by 1, 2)
 select spectrum_id, t.m mz, t.i intensity from t where t.i>0 union all select spectrum_id, mz, intensity from w where c<=20""")
def downsample_spectrum(spark, sf):
    return spectra.downsample(pts_ev(spark, sf), 20)


@query(f"with {EV}, w as (select *, lag(mz) over (partition by spectrum_id order by pos) before from p) select spectrum_id, bool_and(mz>=0 and intensity>=0 and isfinite(mz) and isfinite(intensity) and (before is null or mz>=before)) valid from w group by 1")
def qc_validate(spark, sf):
    """Spectra as they stand in the file, by position, so that an axis out of order shows."""
    return spectra.validate(as_spectra(pts_ev(spark, sf), by="pos"))


def _transformed(method):
    return lambda spark, sf: pts_ev(spark, sf).select("spectrum_id", "pos", F.round(signal.transform(method), 6).alias("value"))


for _m, _s in {"sqrt": "sqrt(greatest(0, intensity))", "log1p": "ln(1+greatest(0, intensity))", "log": f"ln(greatest({EPS}, intensity))", "log2": f"log2(greatest({EPS}, intensity))", "log10": f"log10(greatest({EPS}, intensity))"}.items():
    QUERIES[f"transform_{_m}"], ORACLE_SQL[f"transform_{_m}"] = _transformed(_m), f"with {EV} select spectrum_id, pos, round({_s}, 6) \"value\" from p"


def _normed(method):
    return lambda spark, sf: signal.normalized(pts_ev(spark, sf), method).select("spectrum_id", "pos", F.round("intensity", 6).alias("value"))


for _m, _s in {"tic": "sum(intensity)", "median": "median(intensity)", "rms": "sqrt(sum(intensity*intensity)/count(*))"}.items():
    QUERIES[f"norm_{_m}"] = _normed(_m)
    ORACLE_SQL[f"norm_{_m}"] = f'with {EV}, s as (select spectrum_id, {_s} k from p group by 1) select spectrum_id, pos, round(case when k>0 then intensity/k else intensity end, 6) "value" from p join s using (spectrum_id)'


@query(f"with {EM}, r as (select pos, median(intensity) ref from p group by 1) select spectrum_id, round(median((intensity+{EPS})/(ref+{EPS})), 6) factor from p join r using (pos) group by 1")
def pqn(spark, sf):
    return signal.pqn(pts_em(spark, sf)).select("spectrum_id", F.round("factor", 6).alias("factor"))


@query(f"with {EV} select spectrum_id, pos, round(avg(intensity) over {ORD} rows between 2 preceding and 2 following), 6) smooth from p")
def moving_average(spark, sf):
    return signal.moving_average(pts_ev(spark, sf), 5).select("spectrum_id", "pos", F.round("smooth", 6).alias("smooth"))


@query(f"with {EV} select spectrum_id, pos, round(median(intensity) over {ORD} rows between 5 preceding and 5 following), 6) baseline from p")
def median_baseline(spark, sf):
    return signal.median_baseline(pts_ev(spark, sf), 11).select("spectrum_id", "pos", F.round("baseline", 6).alias("baseline"))


def _snip_sql(k: int) -> str:
    steps, before = [], "p"
    for i in range(1, k + 1):
        source = "intensity" if i == 1 else "b"
        steps.append(f"s{i} as (select spectrum_id, pos, mz, least({source}, coalesce(case when l is null then r when r is null then l else 0.5*(l+r) end, {source})) b from (select *, lag({source}) over {ORD}) l, lead({source}) over {ORD}) r from {before}))")
        before = f"s{i}"
    return f"with {EM}, {', '.join(steps)} select spectrum_id, pos, round(b, 6) baseline from {before}"


@query(_snip_sql(3))
def snip_k3(spark, sf):
    return signal.snip(pts_em(spark, sf).drop("region"), 3).select("spectrum_id", "pos", F.round("baseline", 6).alias("baseline"))


@query(f"""with {EM}, w as (select spectrum_id, pos, (-3*lag(intensity,2) over {ORD})+12*lag(intensity) over {ORD})+17*intensity+12*lead(intensity) over {ORD})-3*lead(intensity,2) over {ORD}))/35 s from p)
 select spectrum_id, pos, round(s, 6) smooth from w where s is not null""")
def sg_interior(spark, sf):
    return signal.smooth_quadratic5(pts_em(spark, sf)).select("spectrum_id", "pos", F.round("smooth", 6).alias("smooth"))


@query(f"with {EV}, {NOISE} select spectrum_id, round(noise, 6) noise from nz")
def mad_noise(spark, sf):
    return signal.noise(pts_ev(spark, sf)).select("spectrum_id", F.round("noise", 6).alias("noise"))


@query(f"""with {EV}, {NOISE}, h as (select spectrum_id, quantile_cont(intensity, 0.95) filter (where intensity>0) q, sum(intensity) tic from p group by 1),
 j as (select *, least(1e6, q/greatest(noise, 1e-6)) snr from nz join h using (spectrum_id))
 select round(avg(noise), 6) mean_noise, round(avg(snr), 6) mean_snr, round(median(snr), 6) median_snr, round(avg(tic), 4) mean_tic, round(stddev_samp(tic)/avg(tic), 6) tic_cv from j""")
def signal_quality(spark, sf):
    return signal.signal_quality(pts_ev(spark, sf))


PEAKS = f"pk as (select p.spectrum_id, pos, mz, intensity, intensity/(noise+{EPS}) snr from p join nz using (spectrum_id) where intensity/(noise+{EPS})>=1.5)"


@query(f"with {EV}, {NOISE}, {PEAKS} select spectrum_id, pos, mz, intensity, round(snr, 6) snr from pk")
def peaks_centroid(spark, sf):
    return peaks.centroid_peaks(pts_ev(spark, sf), 1.5).select("spectrum_id", "pos", "mz", "intensity", F.round("snr", 6).alias("snr"))


@query(f"""with {EM}, {NOISE}, w as (select *, max(intensity) over {ORD} rows between 3 preceding and 3 following) top, min(intensity) over {ORD} rows between 3 preceding and current row) l,
 min(intensity) over {ORD} rows between current row and 3 following) r, row_number() over {ORD}) k, count(*) over (partition by spectrum_id) n from p)
 select spectrum_id, pos, mz, intensity from w join nz using (spectrum_id) where k>1 and k<n and intensity>=top and intensity>2*(noise+{EPS}) and intensity-greatest(l, r)>0.1*intensity""")
def peak_candidates(spark, sf):
    return peaks.peak_candidates(pts_em(spark, sf), 3, 2.0, 0.1)


@query(f"with {EV}, {NOISE}, {PEAKS} select spectrum_id, pos, mz, intensity from pk where snr>=2")
def peak_selection(spark, sf):
    return peaks.select_peaks(peaks.centroid_peaks(pts_ev(spark, sf), 1.5), min_snr=2.0, max_fwhm=500.0).select("spectrum_id", "pos", "mz", "intensity")


@query(f"with {EV}, r as (select *, cast(row_number() over (partition by spectrum_id order by intensity desc, mz, pos) as int) \"rank\" from p) select spectrum_id, pos, mz, intensity, \"rank\" from r where \"rank\"<=3")
def top3_peaks(spark, sf):
    return peaks.top_peaks(pts_ev(spark, sf)).select("spectrum_id", "pos", "mz", "intensity", "rank")


MATCH = """rf as (select 1000.0e0*k reference from range(2, 60) r(k)), mt as (select spectrum_id, reference, arg_min(mz, struct_pack(a:=abs(mz-reference), b:=mz, c:=pos)) mz
 from p, rf where abs(mz-reference)<=reference*500/1e6 group by 1, 2), ac as (select *, 1e6*abs(mz-reference)/reference ppm from mt)"""
ACC = "round(avg(ppm),6) mean_ppm, round(median(ppm),6) median_ppm, round(stddev_samp(ppm),6) std_ppm, round(min(ppm),6) min_ppm, round(max(ppm),6) max_ppm, count(*) n_matches"


def _matched(spark, sf):
    return peaks.matches(pts_li(spark, sf), REFERENCES, 500.0)


@query(f"with {LI}, {MATCH} select spectrum_id, reference, mz, round(ppm, 6) ppm from ac")
def calibration_matches(spark, sf):
    return _matched(spark, sf).withColumn("ppm", F.round("ppm", 6))


@query(f"with {LI}, {MATCH} select {ACC} from ac")
def mass_accuracy(spark, sf):
    return peaks.accuracy(_matched(spark, sf))


@query(f"with {LI}, {MATCH} select spectrum_id%4 region, {ACC} from ac group by 1")
def regional_accuracy(spark, sf):
    return peaks.accuracy(_matched(spark, sf).withColumn("region", F.col("spectrum_id") % 4), "region")


@query(f"with {LI}, {MATCH} select round(coalesce(greatest(10, least(100, avg(ppm)+3*stddev_samp(ppm))), 20), 6) tolerance_ppm from ac")
def adaptive_tolerance(spark, sf):
    return peaks.adaptive_tolerance(_matched(spark, sf))


CHAIN = """g as (select *, case when lag(mz) over w is null or mz-lag(mz) over w>0.05e0 then 1 else 0 end brk from {t} window w as (order by mz, spectrum_id, pos)),
 c as (select *, sum(brk) over (order by mz, spectrum_id, pos rows unbounded preceding) seg from g)"""
PICKED = f"{NOISE}, {PEAKS}"


def _picked(spark, sf):
    return peaks.centroid_peaks(pts_ev(spark, sf), 1.5).select("spectrum_id", "pos", "mz", "intensity")


@query(f"with {EV}, {PICKED}, {CHAIN.format(t='pk')} select round(min(mz),6) mz_lo, round(max(mz),6) mz_hi, round(avg(mz),6) center, count(*) n from c group by seg having count(*)>=2")
def bins_chain(spark, sf):
    rows = peaks.bin_table(peaks.chain_segments(_picked(spark, sf), 0.05), "segment", 2)
    return rows.select(*[F.round(c, 6).alias(c) for c in ("mz_lo", "mz_hi", "center")], "n")


UNI = "u as (select *, cast(floor((mz-lo)/((hi-lo)/100))+1 as int) bin from {t}, (select min(mz) lo, max(mz) hi from {t}))"


@query(f"with {EV}, {PICKED}, {UNI.format(t='pk')} select spectrum_id, bin, max(intensity) \"value\" from u where bin<=100 group by 1, 2")
def bins_uniform(spark, sf):
    return peaks.features(peaks.uniform_bins(_picked(spark, sf), 100), "bin")


@query(f"""with recursive {EV}, {PICKED}, f as (select min(mz) anchor from pk union all select (select min(mz) from pk where mz-f.anchor>0.05e0) from f where anchor is not null),
 a as (select anchor, lead(anchor) over (order by anchor) next from f where anchor is not null)
 select round(avg(mz),6) mz, round(avg(intensity),6) intensity, count(*) n from pk join a on mz>=anchor and (next is null or mz<next) group by anchor having count(*)>=2""")
def bins_anchor(spark, sf):
    rows = peaks.anchor_bins(_picked(spark, sf), 0.05, min_peaks=2)
    return rows.select(F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"), "n")


@query(f"with {EV}, {PICKED}, {CHAIN.format(t='pk')}, b as (select seg, min(mz) lo from c group by 1) select spectrum_id, round(lo,6) mz_lo, max(intensity) \"value\" from c join b using (seg) group by 1, 2")
def feature_matrix_long(spark, sf):
    rows = peaks.chain_segments(_picked(spark, sf), 0.05)
    low = rows.groupBy("segment").agg(F.round(F.min("mz"), 6).alias("mz_lo"))
    return peaks.features(rows, "segment").join(low, "segment").select("spectrum_id", "mz_lo", "value")


@query(f"with {EV}, {UNI.format(t='p')}, v as (select spectrum_id, bin, max(intensity) i from u where bin<=100 group by 1, 2), n as (select count(distinct spectrum_id) n from p) select bin, count(*) present from v, n where i>0 group by bin, n having count(*)>=ceil(0.5e0*n)")
def frequency_filter(spark, sf):
    p = pts_ev(spark, sf)
    total = p.agg(F.countDistinct("spectrum_id").alias("total"))
    rows = peaks.features(peaks.uniform_bins(p, 100), "bin").where("value > 0").groupBy("bin").agg(F.count("*").alias("present"))
    return rows.crossJoin(F.broadcast(total)).where(F.col("present") >= F.ceil(0.5 * F.col("total"))).select("bin", "present")


def _triq_sql(by: str) -> str:
    key, on = (f"{by}, ", f"using ({by})") if by else ("", "on true")
    part = f"partition by {by} " if by else ""
    group = f"group by {by}" if by else ""
    return f"""bs as (select {key}min(intensity) low, max(intensity) up, count(*) total from img {group}),
 bn as (select img.*, low, total, case when up-low+1>=100 then (up-low)/99 else 1.0e0 end step, case when up-low+1>=100 then low else floor(low) end start from img join bs {on}),
 ct as (select {key}floor((intensity-start)/step) bin, step, start, total, count(*) n from bn group by all),
 cu as (select *, abs(0.98e0-(sum(n) over ({part}order by bin))/total) off from ct),
 ed as (select {key}arg_min(start+(bin+1)*step, struct_pack(a:=off, b:=bin)) edge from cu {group}),
 hb as (select {key}max(intensity) high from img join ed {on} where intensity<edge {group}),
 bd as (select {key}low, coalesce(high, low) high from bs left join hb {on})"""


@query(f"with {EV}, {IMAGE}, {_triq_sql('')} select low, high from bd")
def triq_bounds(spark, sf):
    return imaging.outlier_bounds(ion_image(spark, sf))


LEVEL = "cast(case when low>=high or intensity<=low then 0 when intensity>=high then 255 else ceil((intensity-low)/((high-low)/255)) end as int) level"


@query(f"with {EV}, {IMAGE}, {_triq_sql('')} select x, y, intensity, {LEVEL} from img, bd")
def triq_quantize(spark, sf):
    return imaging.triq(ion_image(spark, sf))


@query(f"with {EV}, {IMAGE} select x, y, intensity, cast(round_even(greatest(0, least(255, intensity*255/max(intensity) over ())), 0) as int) level from img")
def quantize_linear(spark, sf):
    return imaging.quantize_linear(ion_image(spark, sf))


@query(f"with {EV}, {MULTI}, {_triq_sql('mass')} select mass, low, high from bd")
def shared_bounds(spark, sf):
    return imaging.outlier_bounds(ion_images_multi(spark, sf), by=("mass",))


@query(f"""with {EV}, {IMAGE}, z as (select max(x) w, max(y) h from img), g as (select w, h, cast(a as int) x, cast(b as int) y from z, range(1, 10000) r(a), range(1, 10000) q(b) where a<=w and b<=h),
 n as (select g.x, g.y, least(w, greatest(1, g.x+dx)) nx, least(h, greatest(1, g.y+dy)) ny from g, (select unnest([-1,0,1]) dx), (select unnest([-1,0,1]) dy))
 select n.x, n.y, median(coalesce(intensity, 0)) intensity from n left join img on img.x=nx and img.y=ny group by 1, 2""")
def image_median3(spark, sf):
    return imaging.median3(ion_image(spark, sf))


@query(f"with {EV}, k as (select spectrum_id, case when spectrum_id%3=0 then 'CENTROID' else 'PROFILE' end mode from p group by 1) select case when count(distinct mode)>1 then 'mixed' else max(mode) end mode, count(*) n, count(*) filter (where mode='PROFILE')>count(*)/2.0 profile_plot from k")
def instrument_modes(spark, sf):
    rows = pts_ev(spark, sf).select("spectrum_id", F.when(F.col("spectrum_id") % 3 == 0, "CENTROID").otherwise("PROFILE").alias("mode")).distinct()
    return rows.agg(F.when(F.countDistinct("mode") > 1, "mixed").otherwise(F.max("mode")).alias("mode"), F.count("*").alias("n"), (F.count_if(F.col("mode") == "PROFILE") > F.count("*") / 2).alias("profile_plot"))


@query(f"with {EM}, d as (select spectrum_id, mz-lag(mz) over {ORD}) dm from p), s as (select spectrum_id, avg(dm) m from d group by 1) select round(avg(m), 6) mean_step, coalesce(stddev_samp(m)/avg(m)<0.01, false) regular from s")
def mz_axis_regular(spark, sf):
    steps = pts_em(spark, sf).withColumn("dm", F.col("mz") - F.lag("mz").over(signal.ordered())).groupBy("spectrum_id").agg(F.avg("dm").alias("m"))
    return steps.agg(F.round(F.avg("m"), 6).alias("mean_step"), F.coalesce(F.stddev_samp("m") / F.avg("m") < 0.01, F.lit(False)).alias("regular"))


def _scans(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") + 1).alias("scan"), (F.col("event_id") * 40).alias("t"))


def _pixels(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") + 1).alias("pixel"), (F.col("event_id") * 41 + 13).alias("t"))


SCANS = "sc as (select event_id+1 scan, event_id*40 t from events), px as (select event_id+1 pixel, event_id*41+13 t from events)"
TIMES = """bo as (select t, 1 is_scan, null pixel from sc union all select t, 0, pixel from px),
 kk as (select pixel, t, coalesce(sum(is_scan) over (order by t, is_scan, pixel rows between unbounded preceding and 1 preceding), 0) k, (select count(*) from sc) n, is_scan from bo),
 mm as (select *, greatest(1, k) la, greatest(1, lag(k, 1, 1) over (order by pixel)) pf, max(case when k>=n then 1 else 0 end) over (order by pixel rows unbounded preceding) spent from kk where is_scan=0),
 ma as (select pixel, t, cast(case when spent=1 then n+1 else least(la, pf) end as bigint) first_scan, cast(case when spent=1 then n else la end as bigint) last_scan from mm)"""


@query(f"with {SCANS}, {TIMES} select pixel, t, first_scan, last_scan from ma")
def scan_pixel_match(spark, sf):
    return convert.match_times(_scans(spark, sf), _pixels(spark, sf))


@query(f"""with {SCANS}, {TIMES}, pd as (select *, greatest(coalesce(lead(t) over (order by pixel)-t, t-lag(t) over (order by pixel), 1), 1) dp from ma),
 sd as (select scan, t ts, greatest(coalesce(lead(t) over (order by scan)-t, t-lag(t) over (order by scan), 1), 1) ds from sc),
 ex as (select *, unnest(range(first_scan, last_scan+1)) scan from pd where first_scan<=last_scan),
 wt as (select pixel, scan, greatest(0.0e0, case when first_scan=last_scan then dp/ds when scan=first_scan then (ts+ds-t)/ds when scan=last_scan then (t+dp-ts)/ds else 1.0e0 end) weight
 from ex join sd using (scan)),
 q as (select event_id+1 scan, user_id%5 pos, "value" intensity from events)
 select pixel, pos, round(sum(weight*intensity), 6) intensity from wt join q using (scan) group by 1, 2""")
def render_pixel(spark, sf):
    scans, pixels = _scans(spark, sf), _pixels(spark, sf)
    points = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") + 1).alias("scan"), (F.col("user_id") % 5).alias("pos"), F.col("value").alias("intensity"))
    rows = convert.render(convert.scan_weights(convert.match_times(scans, pixels), scans), points)
    return rows.select("pixel", "pos", F.round("intensity", 6).alias("intensity"))


@query(f"with {EV}, {STATS} select \"SpectrumID\" from st where 100.5e0>=\"MinMZ\" and 99.5e0<=\"MaxMZ\"")
def candidate_prune(spark, sf):
    return imaging.candidates(spectra.statistics(pts_ev(spark, sf)), 100.0, 0.5).select("SpectrumID")


@query(f"""with {EV}, {STATS} select count(*) n_spectra, round(min("MinMZ"),4) min_mz, round(max("MaxMZ"),4) max_mz, round(avg("TIC"),4) mean_tic, round(avg("BPI"),4) mean_bpi, round(avg("NumPoints"),4) mean_points,
 count(*) filter (where "Mode"='PROFILE') n_profile, count(*) filter (where "Mode"='CENTROID') n_centroid from st""")
def metadata_summary(spark, sf):
    return spectra.metadata_summary(spectra.statistics(pts_ev(spark, sf)))


@query(f"with {EV}, s as (select spectrum_id, sum(mz*intensity)/sum(intensity) centre, count(*) n from p group by 1) select spectrum_id, round(centre, 6) centre, n from s")
def apply_spectra(spark, sf):
    """A user's function over all spectra: the intensity-weighted centre."""
    found = spectra.apply_spectra(as_spectra(pts_ev(spark, sf)), lambda i, mz, y: (i, float((mz * y).sum() / y.sum()), len(mz)), "spectrum_id long, centre double, n long")
    return found.withColumn("centre", F.round("centre", 6))


def _processed_sql(mean: bool) -> str:
    return f"""with {EV}, t as (select spectrum_id, mz, sqrt(greatest(0, intensity)) i from p), k as (select spectrum_id, sum(i) k from t group by 1),
 q as (select spectrum_id, mz, i/k intensity from t join k using (spectrum_id)), r as (select min(mz) lo, max(mz) hi from q), c as (select count(distinct spectrum_id) n from q),
 b as (select cast(greatest(1, least(200, floor((mz-lo)*(199/(hi-lo))+1))) as int) bin, sum(intensity) s from q, r group by 1), g as (select cast(k as int) bin from range(1, 201) t(k))
 select g.bin, round(lo+(g.bin-1)*((hi-lo)/199), 6) mz, round(coalesce(s, 0)/{"c.n" if mean else "1"}, 6) intensity, c.n n_spectra from g left join b on g.bin=b.bin, r, c"""


def _processed(spark, sf):
    rows = pts_ev(spark, sf).withColumn("intensity", signal.transform("sqrt"))
    return signal.normalized(rows, "tic")


@query(_processed_sql(False))
def processed_sum_spectrum(spark, sf):
    return spectra.processed_total(_processed(spark, sf), 200)


@query(_processed_sql(True))
def processed_mean_spectrum(spark, sf):
    return spectra.processed_total(_processed(spark, sf), 200, mean=True)


@query(f"with {EV}, {NOISE}, r as (select avg(mz)*100 r from p) select round(avg(noise) filter (where noise>0 and isfinite(noise)), 6) noise, any_value(case when r>40000 then 5 when r>10000 then 7 else 9 end) \"window\" from nz, r")
def noise_hints(spark, sf):
    """The resolution is that of peaks a hundredth wide at the mean m/z."""
    p = pts_ev(spark, sf)
    return spectra.noise_hints(signal.noise(p), (p.agg(F.avg("mz")).first()[0] or 0.0) * 100).withColumn("noise", F.round("noise", 6))


@query(f"with {LI}, n as (select count(*) n from p group by spectrum_id) select round(avg(n), 6) mean_points, median(n) median_points, cast(sum(n) as bigint) total_points, count(*) n_spectra from n")
def peak_characteristics(spark, sf):
    return spectra.peak_characteristics(pts_li(spark, sf)).withColumn("mean_points", F.round("mean_points", 6))


@query(f"with {EV}, q as (select spectrum_id, x, y, mz, case when pos%13=0 then 0.0e0 else intensity end intensity from p where x between 1 and 10 and y between 1 and 8), {_image_sql('mz between 105.0e0 and 115.0e0').replace('from p', 'from q')} select * from img")
def ion_image_raster(spark, sf):
    """Only pixels inside the raster count, and NaN intensities are 0."""
    p = pts_ev(spark, sf)
    return imaging.ion_image(p.withColumn("intensity", F.when(F.col("pos") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("intensity"))), 110.0, 5.0, size=(10, 8))


@query(f"with {LI}, {STATS}, masses as (select unnest([1000.0e0, 2000.0e0, 104000.0e0]) mass), ok as (select distinct \"SpectrumID\" spectrum_id from st, masses where mass+50.0e0>=\"MinMZ\" and mass-50.0e0<=\"MaxMZ\"), {_image_sql('mz between mass-50.0e0 and mass+50.0e0', 'mass', 'semi join ok using (spectrum_id), masses')} select * from img")
def ion_images_pruned(spark, sf):
    """The points are stored by blocks with their statistics; the images read the candidates' blocks alone."""
    folder, masses = own_folder(spark, "points"), [1000.0, 2000.0, 104000.0]
    stored.store_points(pts_li(spark, sf), folder)
    return imaging.ion_images(stored.candidate_points(spark, folder, masses, 50.0), masses, 50.0)


@query(f"""with {EV}, m as (select distinct x, y from p where (x+y)%3<>0), z as (select max(x) w, max(y) h from m)
 select 'flip_x' op, cast(w-x+1 as int) x, y from m, z union all select 'flip_y', x, cast(h-y+1 as int) from m, z union all select 'shift', cast(x+2 as int), cast(y-1 as int) from m, z where x+2<=w and y-1>=1
 union all select 'inverse', cast(a as int), cast(b as int) from z, range(1, 1000) r(a), range(1, 1000) q(b) where a<=w and b<=h and not exists (select 1 from m where m.x=a and m.y=b)""")
def mask_ops(spark, sf):
    """Flips, a shift and the inverse of a mask, as pixels."""
    from functools import reduce

    mask = checker_mask(pts_ev(spark, sf))
    rows = [imaging.mask_flipped(mask, "x"), imaging.mask_flipped(mask, "y"), imaging.mask_shifted(mask, 2, -1), imaging.mask_inverse(mask)]
    return reduce(DataFrame.union, [r.select(F.lit(n).alias("op"), "x", "y") for n, r in zip(("flip_x", "flip_y", "shift", "inverse"), rows, strict=True)])


@query(f"""with {LI}, {MATCH}, reg as (select distinct x, y, cast(x%3 as int) region from p), a as (select region, avg(ppm) m, count(*) n from ac join (select distinct spectrum_id, x, y from p) using (spectrum_id) join reg using (x, y) group by 1)
 select region, round(m, 6) mean_ppm, n n_matches, round((select max(m)-min(m) from a), 6) range_of_means from a""")
def regional_masks(spark, sf):
    """Accuracy by the regions of masks, and how far the regions' means lie apart."""
    p = pts_li(spark, sf)
    region = p.select("x", "y", (F.col("x") % 3).cast("int").alias("region")).distinct()
    found = _matched(spark, sf).join(p.select("spectrum_id", "x", "y").distinct(), "spectrum_id").join(region, ["x", "y"])
    return peaks.regional_report(found, "region")


FILES = f"f as (select 'a' file, x, y, intensity from (with {EV}, {IMAGE} select * from img) union all select 'b', x, y, intensity from (with {EM}, {IMAGE} select * from img))"


@query(f"with {FILES}, img as (select * from f), {_triq_sql('')} select file, x, y, intensity, {LEVEL} from img, bd")
def several_files(spark, sf):
    """One contrast for the images of several data sets."""
    both = datasets.together({"a": imaging.ion_image(pts_ev(spark, sf), 110.0, 5.0), "b": imaging.ion_image(pts_em(spark, sf), 110.0, 5.0)})
    return imaging.set_depth(both, imaging.outlier_bounds(both)).select("file", "x", "y", "intensity", "level")


@query("with i as (select user_id%7 folder, 'img_' || (event_id%1000) || '.bmp' name from events group by 1, 2), k as (select *, regexp_extract(name, '[0-9]+') d from i) select folder, name, coalesce(lag(name) over w, name) previous, coalesce(lead(name) over w, name) \"next\" from k window w as (partition by folder order by lpad(d, 20, '0'), name)")
def image_neighbours(spark, sf):
    """The images before and after each in natural order."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return datasets.with_neighbours(e.select((F.col("user_id") % 7).alias("folder"), F.concat(F.lit("img_"), (F.col("event_id") % 1000).cast("string"), F.lit(".bmp")).alias("name")).distinct(), "folder", "name")


@query("select count(*) n, count(distinct user_id) n_distinct, count(*)<>count(distinct user_id) duplicates from events")
def duplicate_indices(spark, sf):
    return datasets.has_duplicates(spark.read.parquet(f"{sf}/events.parquet"), "user_id")


@query("select p_partkey, p_retailprice>950 is_imzml from part")
def batch_list(spark, sf):
    """A list that takes in what it doesn't hold yet."""
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_retailprice") > 950).alias("is_imzml"))
    return datasets.appended(rows.where("is_imzml"), rows.union(rows), "p_partkey")


@query("select p_partkey from part where p_retailprice>950")
def image_capable(spark, sf):
    return datasets.image_capable(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_retailprice") > 950).alias("is_imzml"))).select("p_partkey")


@query(f"with {EV} select distinct x, y, cast((y-1)*15+x as int) flat from p")
def pixel_numbers(spark, sf):
    return pts_ev(spark, sf).select("x", "y", datasets.flat_index(15).cast("int").alias("flat")).distinct()


#: A raster of 25 columns: the profile view's ion image, its threshold, and the mask of the pixels that reach it.
IMG = f"{EM}, img as (select x, y, max(intensity) intensity from p where mz between 99.75e0 and 100.25e0 group by 1, 2 having max(intensity)>0)"
SIZE = "size as (select 25 w, max(y) h from img), grid as (select cast(i as int) x, cast(j as int) y from size, range(1, 26) r(i), range(1, 100001) q(j) where j<=h)"
OTSU = """span as (select min(intensity) low, max(intensity) high from img), hb as (select least(255, floor((intensity-low)/((high-low)/256))) bin, count(*)::double n, any_value(low) low, any_value(high) high from img, span group by 1),
 hc as (select *, low+(bin+0.5)*((high-low)/256) middle from hb), hd as (select bin, middle, sum(n) over (order by bin) b, sum(n) over ()-sum(n) over (order by bin) a, sum(n*middle) over (order by bin) m, sum(n*middle) over ()-sum(n*middle) over (order by bin) r from hc),
 th as (select middle threshold from hd where a>0 and b>0 order by round(b*a*(m/b-r/a)**2, 6) desc, bin limit 1), mask as (select x, y from img, th where intensity>=threshold)"""
LABELS = """reach(x, y, s) as (select x, y, y*100000+x from mask union select m.x, m.y, r.s from reach r join mask m on abs(m.x-r.x)+abs(m.y-r.y)=1), lab as (select x, y, min(s) s from reach group by 1, 2)"""


def _raster(spark, sf):
    return imaging.ion_image(pts_em(spark, sf), 100.0, 0.25)


def _height(image):
    return image.agg(F.max("y")).first()[0] or 0


@query(f"with {IMG}, {OTSU} select round(threshold, 9) threshold from th")
def otsu_threshold(spark, sf):
    return regions.otsu_threshold(_raster(spark, sf)).select(F.round("threshold", 9).alias("threshold"))


@query(f"with recursive {IMG}, {OTSU}, {LABELS} select x, y, cast(s//100000 as int) region_y, cast(s%100000 as int) region_x from lab")
def mask_regions(spark, sf):
    """The connected regions of the pixels above the threshold."""
    return regions.regions(regions.binarized(_raster(spark, sf)), 8)


@query(f"with recursive {IMG}, {OTSU}, {LABELS} select x, y from lab where s in (select s from lab group by 1 having count(*)>=4)")
def mask_opened(spark, sf):
    return regions.area_opened(regions.binarized(_raster(spark, sf)), 4)


@query(f"""with recursive {IMG}, {SIZE}, {OTSU.replace("mask as", "lit as").replace("from img, th", "from img, th")}, mask as (select x, y from grid anti join lit using (x, y)), {LABELS}
 select x, y from grid anti join (select x, y from lab where s in (select s from lab group by 1 having count(*)>=3)) using (x, y)""")
def mask_filled(spark, sf):
    """Holes of fewer than three pixels are filled."""
    image = _raster(spark, sf)
    return regions.area_closed(regions.binarized(image), 3, 25, _height(image))


@query(f"""with {IMG}, {SIZE}, {OTSU}, o as (select unnest([-1, 0, 1]) d), gr as (select distinct m.x+a.d x, m.y+b.d y from mask m, o a, o b)
 select grid.x, grid.y from grid join gr on abs(gr.x-grid.x)<=1 and abs(gr.y-grid.y)<=1 group by 1, 2 having count(*)=9""")
def mask_closed(spark, sf):
    """Dilation and erosion by a square of three."""
    image = _raster(spark, sf)
    return regions.closed(regions.binarized(image), 3, 25, _height(image))


@query(f"""with {IMG}, {SIZE}, v as (select grid.x, grid.y, coalesce(intensity, 0) v, h from grid left join img using (x, y), size), w as (select d, exp(-d*d/18.0e0)/sum(exp(-d*d/18.0e0)) over () w from range(-6, 7) r(d)),
 a as (select v.x, v.y, v.h, sum(w*n.v) v from v, w join v n on n.y=v.y and n.x=greatest(1, least(25, v.x+d)) group by 1, 2, 3)
 select a.x, a.y, round(sum(w*n.v), 6) intensity from a, w join a n on n.x=a.x and n.y=greatest(1, least(a.h, a.y+d)) group by 1, 2""")
def surface_smoothed(spark, sf):
    """The ion image under a Gaussian of three pixels."""
    image = _raster(spark, sf)
    return surfaces.gaussian(image, 25, _height(image), 3.0, tile=16).withColumn("intensity", F.round("intensity", 6))


@query(f"""with {IMG}, {SIZE}, t as (select *, greatest(0e0, least(24e0, (cast(x as double)-0.5e0)*2.5e0-0.5e0)) ax, greatest(0e0, least(h-1e0, (cast(y as double)-0.5e0)*(h/7e0)-0.5e0)) ay from (select cast(i as int) x, cast(j as int) y, h from range(1, 11) r(i), range(1, 8) q(j), size)),
 c as (select x, y, unnest([floor(ax), least(24, floor(ax)+1)]) gx, unnest([1-(ax-floor(ax)), ax-floor(ax)]) wx, ay, h from t), e as (select x, y, gx, wx, unnest([floor(ay), least(h-1, floor(ay)+1)]) gy, unnest([1-(ay-floor(ay)), ay-floor(ay)]) wy from c)
 select e.x, e.y, round(sum(wx*wy*coalesce(intensity, 0)), 6) intensity from e left join img on img.x=gx+1 and img.y=gy+1 group by 1, 2""")
def image_resized(spark, sf):
    """The ion image brought to 10 x 7 pixels."""
    image = _raster(spark, sf)
    full = image.unionByName(spark.createDataFrame([(25, _height(image), 0.0)], "x int, y int, intensity double")).groupBy("x", "y").agg(F.max("intensity").alias("intensity"))
    return image_files.resized(full, 10, 7).withColumn("intensity", F.round("intensity", 6))


@query(f"with {EM} select pos, round(quantile_cont(intensity, 0.9), 9) high from p group by 1")
def position_quantiles(spark, sf):
    """The 90th percentile of every position over all spectra, by refined histograms."""
    return quantiles.quantiles(pts_em(spark, sf), ["pos"], "intensity", 0.9, "high").withColumn("high", F.round("high", 9))


@query(f"with {LI}, r as (select round(quantile_cont(intensity, 0.5), 9) middle, round(quantile_cont(mz, 0.999), 6) far from p) select * from r")
def global_quantiles(spark, sf):
    p = pts_li(spark, sf)
    middle, far = quantiles.quantiles(p, [], "intensity", 0.5, "middle"), quantiles.quantiles(p, [], "mz", 0.999, "far")
    return middle.crossJoin(far).select(F.round("middle", 9).alias("middle"), F.round("far", 6).alias("far"))


@query(f"with {LI}, g as (select distinct mz from p) select mz, row_number() over (order by mz) k from g")
def numbered_axis(spark, sf):
    """The distinct m/z with their numbers, sorted in ranges."""
    return numbered(pts_li(spark, sf).select("mz").distinct(), ["mz"], "k").select("mz", "k")


@query(f"with {EV} select cast(max(x) as int) width, cast(max(y) as int) height, (select count(*) from (select distinct x, y from p)) n_pixels from p")
def raster_dimensions(spark, sf):
    return spectra.dimensions(pts_ev(spark, sf))


@query(f"with {EV}, o as (select *, lag(mz) over (partition by spectrum_id order by pos) before from p) select spectrum_id, false empty, count(*) filter (where mz<before)=0 regular from o group by 1")
def qc_flags(spark, sf):
    """Empty and regular spectra, in the order in which their points came."""
    return spectra.quality(as_spectra(pts_ev(spark, sf), by="pos"))


@query(f"with {EM} select round(log10(max(intensity) filter (where intensity>0)/min(intensity) filter (where intensity>0)), 6) orders from p")
def intensity_orders(spark, sf):
    return spectra.dynamic_range(pts_em(spark, sf))


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    return as_spectra(pts_em(spark, sf))


def _kernel(*steps):
    """Rows-only queries: kernels that SQL does not express."""
    from ionlake.plans.preprocessing import run_steps

    return lambda spark, sf: run_steps(_profiles(spark, sf), list(steps))[0]


def _peaks_of(*steps):
    from ionlake.plans.preprocessing import peak_rows

    return lambda spark, sf: peak_rows(_kernel(*steps)(spark, sf))


#: The hull under a signal is, at every point, the lowest of all chords over it.
HULL_SQL = f"""with {EM}, b as (select i.spectrum_id, i.pos, min(case when l.mz=r.mz then i.intensity else l.intensity+(r.intensity-l.intensity)*((i.mz-l.mz)/(r.mz-l.mz)) end) base
 from p i join p l on l.spectrum_id=i.spectrum_id and l.mz<=i.mz join p r on r.spectrum_id=i.spectrum_id and r.mz>=i.mz where (l.mz<i.mz)=(r.mz>i.mz) group by 1, 2)
 select spectrum_id, pos, round(greatest(0, intensity-base), 9) intensity from p join b using (spectrum_id, pos)"""
_LISTS = f"{EM}, s as (select spectrum_id, list(intensity order by mz, pos) y, list(mz order by mz, pos) x, count(*) n from p group by 1)"
SNIP_SQL = f"""with recursive {_LISTS}, r as (select spectrum_id, y, y b, n, 0 k from s union all
 select spectrum_id, y, [least(b[i], case when i=1 then b[2] when i=n then b[n-1] else (b[i-1]+b[i+1])/2 end) for i in range(1, n+1)], n, k+1 from r where k<100)
 select spectrum_id, unnest(range(n)) pos, round(unnest([greatest(0, y[i]-b[i]) for i in range(1, n+1)]), 9) intensity from r where k=100"""
WIDTH_SQL = f"""with {_LISTS}, t as (select *, list_position(y, list_max(y)) k from s), c as (select *, y[k]/2 h, list_max([i for i in range(1, k) if y[i]<y[k]/2]) a, list_min([i for i in range(k+1, n+1) if y[i]<y[k]/2]) b from t),
 w as (select *, (x[b-1]+(h-y[b-1])*(x[b]-x[b-1])/(y[b]-y[b-1]))-(x[a]+(h-y[a])*(x[a+1]-x[a])/(y[a+1]-y[a])) w, k>=3 and k<=n-2 inner_ from c)
 select spectrum_id, x[k] mz, round(case when inner_ and w>0 and w<=50 then w end, 6) robust, round(w, 6) fwhm, round(case when inner_ and w>0 and w<=1 then x[k]/w end, 6) resolution from w"""


def _register() -> None:
    from ionlake.plans.advisor import recommend
    from ionlake.plans.preprocessing import Step, peak_rows, run_steps

    pick = Step("peak_picking", {"method": "profile", "snr": 1.0, "half_window": 3})

    def corrected(method, **params):
        rows = lambda spark, sf: _kernel(Step("baseline_correction", {"method": method, **params}))(spark, sf).select("spectrum_id", F.posexplode("intensity").alias("pos", "value"))
        return lambda spark, sf: rows(spark, sf).select("spectrum_id", F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("intensity"))

    def fwhm_r2(spark, sf):
        return _peaks_of(pick)(spark, sf).select("spectrum_id", "mz", "fwhm", "shape_r2")

    def pipeline_full(spark, sf):
        steps = [Step("stabilization"), Step("smoothing", {"window": 5}), Step("baseline_correction", {"iterations": 20}), Step("normalization"), pick, Step("peak_selection", {"min_snr": 1.0}), Step("peak_alignment", {"method": "linear"}), Step("peak_binning", {"tolerance": 0.05})]
        return run_steps(_profiles(spark, sf), steps)[1]

    def advisor(spark, sf):
        rows = [(k, n, str(v)) for k, d in recommend(pts_em(spark, sf).drop("region"), [110.0, 120.0]).items() for n, v in d.items()]
        return spark.createDataFrame(rows, "step string, name string, value string")

    def resolution_of_peaks(spark, sf):
        import numpy as np

        from ionlake.functions import kernels

        top = lambda i, mz, y: (i, float(mz[(k := int(np.argmax(y)))]), kernels.robust_fwhm(mz, y, k, 50.0), kernels.fwhm(mz, y, k), kernels.resolution(mz, y, k))
        rows = spectra.apply_spectra(_profiles(spark, sf), top, "spectrum_id long, mz double, robust double, fwhm double, resolution double")
        known = lambda c: F.when(~F.isnan(c), F.round(c, 6)).alias(c)
        return rows.select("spectrum_id", "mz", known("robust"), known("fwhm"), known("resolution"))

    def sql_peaks(spark, sf):
        from ionlake.plans import sql

        sql.register(spark)
        view = f"profiles_{uuid.uuid4().hex}"
        _profiles(spark, sf).select("spectrum_id", "mz", "intensity").createOrReplaceTempView(view)
        return spark.sql(f"SELECT * FROM detect_peaks(TABLE({view}), method => 'profile', snr => 1.0, half_window => 3)")

    def peak_shapes(spark, sf):
        return spectra.peak_shapes(_profiles(spark, sf), snr=1.0, half_window=3)

    QUERIES.update({"sql_peaks": sql_peaks, "peak_shapes": peak_shapes})
    QUERIES["resolution_of_peaks"] = resolution_of_peaks
    QUERIES.update({"peaks_profile": _peaks_of(pick), "peaks_wavelet": _peaks_of(Step("peak_picking", {"method": "wavelet", "snr": 1.0}))})
    for method in ("linear", "lowess", "ransac"):
        QUERIES[f"align_{method}"] = lambda spark, sf, m=method: peak_rows(run_steps(_profiles(spark, sf), [pick, Step("peak_alignment", {"method": m, "tol": 0.6})])[0]).select("spectrum_id", "pos", "mz")
    for f in (fwhm_r2, pipeline_full, advisor):
        QUERIES[f.__name__] = f
    QUERIES.update({"hull_baseline": corrected("convex_hull"), "snip_baseline": corrected("snip", iterations=100)})
    ORACLE_SQL.update({"hull_baseline": HULL_SQL, "snip_baseline": SNIP_SQL, "resolution_of_peaks": WIDTH_SQL})


_register()
