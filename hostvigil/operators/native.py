"""The recurrences of `ladder` in the JVM, for scans over long histories.

The text below is compiled by the compiler that Spark brings along for its own generated code; executors get the classes as
a jar. A host's frames pass through it row by row, with the steps of `Baselines`, `Net` and `Drift` in the same order: sums
of products as math.sumprod makes them, the exponential of fdlibm. So what is learned equals the plain numbers of `ladder`
to the last bit, which streams and resumed scans go on with. Indices of drift may differ in their last digit (np.log).
"""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hostvigil.sources.scratch import driver_path

NAME = "hostvigil.Climb"
SOURCE = r"""
package hostvigil;

import java.util.Arrays;
import java.util.Iterator;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;

public class Climb implements org.apache.spark.api.java.function.MapPartitionsFunction, java.io.Serializable {
    static final long serialVersionUID = 1L;
    static final int WIDTH = 8;
    final String text;

    public Climb(String text) {
        this.text = text;
    }

    public Iterator call(Iterator rows) {
        return new Frames(new Plan(text), rows);
    }

    /** What is asked for, a line each: see `climbed`. */
    public static class Plan {
        int host, ts, learn;
        int[] kept, packed, features, netOf;
        double[] sign, limits;
        boolean l1, l2, drift, adapt;
        boolean[] wanted = new boolean[WIDTH];
        String[] names;
        int[][] places;
        double[][] first, again;

        Plan(String text) {
            String[] lines = text.split("\n", -1);
            int[] at = ints(lines[0]);
            host = at[0];
            ts = at[1];
            learn = at[2];
            kept = ints(lines[1]);
            features = ints(lines[2]);
            sign = doubles(lines[3]);
            limits = lines[4].length() == 0 ? null : doubles(lines[4]);
            netOf = ints(lines[5]);
            packed = ints(lines[6]);
            int[] flags = ints(lines[7]);
            l1 = flags[0] == 1;
            l2 = flags[1] == 1;
            drift = flags[2] == 1;
            adapt = flags[3] == 1;
            for (int k = 0; k < WIDTH; k++) wanted[k] = flags[4 + k] == 1;
            names = lines[8].split(" ");
            int nets = (lines.length - 9) / 3;
            places = new int[nets][];
            first = new double[nets][];
            again = new double[nets][];
            for (int k = 0; k < nets; k++) {
                places[k] = ints(lines[9 + 3 * k]);
                first[k] = doubles(lines[10 + 3 * k]);
                again[k] = doubles(lines[11 + 3 * k]);
            }
        }

        static int[] ints(String line) {
            double[] found = doubles(line);
            int[] out = new int[found.length];
            for (int k = 0; k < out.length; k++) out[k] = (int) found[k];
            return out;
        }

        static double[] doubles(String line) {
            if (line.length() == 0) return new double[0];
            String[] words = line.split(" ");
            double[] out = new double[words.length];
            for (int k = 0; k < out.length; k++) out[k] = Double.parseDouble(words[k]);
            return out;
        }
    }

    /** The rows with what a host's frames add to them; a host's frames come in order of time. */
    public static class Frames implements Iterator {
        final Plan plan;
        final Iterator rows;
        Object host = null;
        Host state = null;

        Frames(Plan plan, Iterator rows) {
            this.plan = plan;
            this.rows = rows;
        }

        public boolean hasNext() {
            return rows.hasNext();
        }

        public Object next() {
            Row row = (Row) rows.next();
            Object now = row.get(plan.host);
            if (state == null || (now == null ? host != null : !now.equals(host))) {
                host = now;
                state = new Host(plan);
            }
            int n = plan.kept.length, m = plan.packed.length;
            Object[] out = new Object[n + WIDTH + (m > 0 ? 1 : 0)];
            for (int k = 0; k < n; k++) out[k] = row.get(plan.kept[k]);
            state.frame(row, out, n);
            if (m > 0) {
                Object[] values = new Object[m];
                for (int k = 0; k < m; k++) values[k] = row.get(plan.packed[k]);
                out[n + WIDTH] = values;
            }
            return RowFactory.create(out);
        }

        public void remove() {
            throw new UnsupportedOperationException();
        }
    }

    /** Sums of products as math.sumprod makes them: in three parts, rounded at the end. */
    public static class Sum {
        double hi, lo, tiny;

        void start() {
            hi = 0.0;
            lo = 0.0;
            tiny = 0.0;
        }

        void plus(double x, double y) {
            double p = x * y, q = Math.fma(x, y, -p);
            double a = hi + p, z = a - hi, rest = (hi - (a - z)) + (p - z);
            double b = lo + q, y1 = b - lo, r1 = (lo - (b - y1)) + (q - y1);
            double c = b + rest, y2 = c - b, r2 = (b - (c - y2)) + (rest - y2);
            hi = a;
            lo = c;
            tiny = tiny + r1 + r2;
        }

        double total() {
            return hi + (lo + tiny);
        }
    }

    public static class Net {
        final int n, h;
        final double[] again;
        final double[][] into, back;
        final double[] into0, back0, least, most, scaled, inner, outer, gap, slope, below;
        double trained, frozen, error, spread, rmse, score, relative;
        final Sum sum = new Sum();

        /** Weights: those into the hidden units by input, then those back by hidden unit. */
        Net(int n, double[] first, double[] again) {
            this.n = n;
            this.h = first.length / (2 * n);
            this.again = again;
            into = new double[h][n];
            back = new double[h][n];
            into0 = new double[h];
            inner = new double[h];
            below = new double[h];
            back0 = new double[n];
            least = new double[n];
            most = new double[n];
            scaled = new double[n];
            outer = new double[n];
            gap = new double[n];
            slope = new double[n];
            start(first);
        }

        void restart() {
            start(again);
        }

        private void start(double[] weights) {
            for (int j = 0; j < h; j++)
                for (int k = 0; k < n; k++) {
                    into[j][k] = weights[k * h + j];
                    back[j][k] = weights[n * h + j * n + k];
                }
            Arrays.fill(into0, 0.0);
            Arrays.fill(back0, 0.0);
            Arrays.fill(least, Double.POSITIVE_INFINITY);
            Arrays.fill(most, Double.NEGATIVE_INFINITY);
            trained = 0.0;
            frozen = 0.0;
            error = 0.0;
            spread = 0.0;
        }

        static double squash(double x) {
            return 1 / (1 + StrictMath.exp(x < -30 ? 30 : x > 30 ? -30 : -x));
        }

        double usual() {
            double a = spread > 0 ? error + 3 * Math.sqrt(spread) : error, b = 1.5 * error, most = 1e-3;
            most = a > most ? a : most;
            return b > most ? b : most;
        }

        void widen(double[] x) {
            for (int k = 0; k < n; k++) {
                least[k] = x[k] < least[k] ? x[k] : least[k];
                most[k] = x[k] > most[k] ? x[k] : most[k];
            }
        }

        void frame(double[] x, boolean learn) {
            boolean warm = trained >= NET_WARM, wider = false;
            if (learn && !warm) widen(x);
            for (int k = 0; k < n; k++) {
                double v = x[k], span = most[k] - least[k];
                if (1e-9 < span && span < Double.POSITIVE_INFINITY) {
                    v = (v - least[k]) / span;
                    if (v < 0.0 || v > 1.0) wider = true;
                } else {
                    wider = true;
                    v = Double.isInfinite(least[k]) ? v : v - least[k];
                }
                scaled[k] = v < 0.0 ? 0.0 : v > 1.0 ? 1.0 : v;
            }
            for (int j = 0; j < h; j++) {
                double[] row = into[j];
                sum.start();
                for (int k = 0; k < n; k++) sum.plus(row[k], scaled[k]);
                inner[j] = squash(sum.total() + into0[j]);
            }
            for (int k = 0; k < n; k++) {
                sum.start();
                for (int j = 0; j < h; j++) sum.plus(back[j][k], inner[j]);
                outer[k] = squash(sum.total() + back0[k]);
                gap[k] = outer[k] - scaled[k];
            }
            sum.start();
            for (int k = 0; k < n; k++) sum.plus(gap[k], gap[k]);
            rmse = Math.sqrt(sum.total() / n);
            double usual = usual();
            if (learn) {
                if (warm && frozen < FREEZE_STEPS && (rmse / usual - 1) / 2 >= NET_FREEZE) frozen += 1.0;
                else {
                    frozen = 0.0;
                    if (warm && wider) widen(x);
                    learn();
                    trained += 1.0;
                    if (trained > SETTLE) {
                        double rate = 1 / (trained - SETTLE), off = rmse - error;
                        rate = rate < 0.01 ? 0.01 : rate;
                        rate = rate > 0.2 ? 0.2 : rate;
                        error += rate * off;
                        spread = (1 - rate) * (spread + rate * off * off);
                        usual = usual();
                    }
                }
            }
            double excess = trained >= NET_WARM ? (rmse / usual - 1) / 2 : 0.0;
            score = excess < 0.0 ? 0.0 : excess > 1.0 ? 1.0 : excess;
            relative = rmse / usual;
        }

        private void learn() {
            for (int k = 0; k < n; k++) slope[k] = gap[k] * outer[k] * (1 - outer[k]);
            for (int j = 0; j < h; j++) {
                double[] row = back[j];
                sum.start();
                for (int k = 0; k < n; k++) sum.plus(row[k], slope[k]);
                below[j] = LEARNING * sum.total() * inner[j] * (1 - inner[j]);
            }
            for (int k = 0; k < n; k++) {
                double step = LEARNING * slope[k];
                for (int j = 0; j < h; j++) back[j][k] -= inner[j] * step;
                back0[k] -= step;
            }
            for (int j = 0; j < h; j++) {
                double[] row = into[j];
                for (int k = 0; k < n; k++) row[k] -= below[j] * scaled[k];
                into0[j] -= below[j];
            }
        }
    }

    /** The last values of a feature. */
    public static class Ring {
        final double[] values;
        int count = 0, at = 0;

        Ring(int size) {
            values = new double[size];
        }

        /** What falls out; NaN if nothing does, or nothing comes. */
        double push(double x) {
            if (x != x) return x;
            double out = count == values.length ? values[at] : Double.NaN;
            values[at] = x;
            at = (at + 1) % values.length;
            if (count < values.length) count++;
            return out;
        }

        /** Takes over the values of a smaller one, oldest first. */
        void take(Ring other) {
            int from = other.count == other.values.length ? other.at : 0;
            for (int k = 0; k < other.count; k++) values[k] = other.values[(from + k) % other.values.length];
            count = other.count;
            at = count % values.length;
        }
    }

    public static class Host {
        final Plan plan;
        final int size;
        final double[] x, last, lastAt, smooth, high, low, frozen, psi, drifted, joint;
        final double[][] count, mean, var, inputs;
        final Ring[] reference, recent;
        final Net[] nets;
        final Net output;
        int frames = 0;

        Host(Plan plan) {
            this.plan = plan;
            size = plan.features.length;
            x = new double[size];
            last = new double[size];
            lastAt = new double[size];
            Arrays.fill(last, Double.NaN);
            Arrays.fill(lastAt, Double.NEGATIVE_INFINITY);
            smooth = new double[size];
            high = new double[size];
            low = new double[size];
            frozen = new double[size];
            psi = new double[size];
            drifted = new double[size];
            count = new double[HOURS + 1][size];
            mean = new double[HOURS + 1][size];
            var = new double[HOURS + 1][size];
            reference = new Ring[size];
            recent = new Ring[size];
            for (int k = 0; k < size; k++) {
                reference[k] = new Ring(REFERENCE_SIZE);
                recent[k] = new Ring(RECENT_SIZE);
            }
            int layers = plan.places.length - 1;
            nets = new Net[layers];
            inputs = new double[layers][];
            for (int l = 0; l < layers; l++) {
                inputs[l] = new double[plan.places[l].length];
                nets[l] = new Net(inputs[l].length, plan.first[l], plan.again[l]);
            }
            joint = new double[layers];
            output = new Net(layers, plan.first[layers], plan.again[layers]);
        }

        void frame(Row row, Object[] out, int to) {
            double ts = row.getDouble(plan.ts);
            boolean learn = plan.learn < 0 || row.getBoolean(plan.learn);
            for (int k = 0; k < size; k++) {
                int at = plan.features[k];
                double v = row.isNullAt(at) ? Double.NaN : row.getDouble(at);
                if (plan.limits != null) {
                    if (v == v) {
                        last[k] = v;
                        lastAt[k] = ts;
                    }
                    v = ts - lastAt[k] <= plan.limits[k] ? last[k] : Double.NaN;
                }
                x[k] = v;
            }
            if (plan.l1) {
                Object[] l1 = plan.wanted[0] ? new Object[size] : null, highs = plan.wanted[1] ? new Object[size] : null;
                int hour = (int) Math.floorMod((long) Math.floor(ts / 3600), (long) HOURS);
                for (int k = 0; k < size; k++)
                    if (x[k] == x[k]) {
                        double value = baseline(k, hour, learn);
                        if (l1 != null) l1[k] = Double.valueOf(value);
                        if (highs != null) highs[k] = Double.valueOf(high[k]);
                    }
                out[to] = l1;
                out[to + 1] = highs;
            }
            if (plan.l2) layers(learn, out, to + 2);
            if (plan.drift && learn) drift(ts, out, to + 6);
        }

        private double baseline(int k, int hour, boolean learn) {
            double v = x[k], z = 0.0;
            double n = count[hour][k], m = mean[hour][k], s = var[hour][k];
            double nAll = count[HOURS][k], mAll = mean[HOURS][k], sAll = var[HOURS][k];
            double gap = v - m, gapAll = v - mAll;
            if (n >= BUCKET_WARM) {
                double spread = s > 0.0 ? Math.sqrt(s) : 0.0, least = SPREAD_FLOOR * Math.abs(m);
                spread = least > spread ? least : spread;
                z = plan.sign[k] * gap / (spread > 1e-6 ? spread : 1e-6);
            } else if (nAll >= 4) {
                double spread = sAll > 0.0 ? Math.sqrt(sAll) : 0.0, least = SPREAD_FLOOR * Math.abs(mAll);
                spread = least > spread ? least : spread;
                z = plan.sign[k] * gapAll / (COLD_SPREAD * (spread > 1e-6 ? spread : 1e-6));
            }
            double now = z - DEADBAND;
            now = now < 0.0 ? 0.0 : now > MAX_CONTRIBUTION ? MAX_CONTRIBUTION : now;
            if (!learn) return now;
            smooth[k] += SMOOTHING * (now - smooth[k]);
            double up = high[k] + z - CUSUM_K, down = low[k] - z - CUSUM_K;
            high[k] = up < 0.0 ? 0.0 : up > CUSUM_LIMIT ? CUSUM_LIMIT : up;
            low[k] = down < 0.0 ? 0.0 : down > CUSUM_LIMIT ? CUSUM_LIMIT : down;
            if (now >= FREEZE_AT && frozen[k] < FREEZE_STEPS && nAll >= FREEZE_COUNT) {
                frozen[k] += 1.0;
                return smooth[k];
            }
            frozen[k] = 0.0;
            moments(hour, k, gap);
            moments(HOURS, k, gapAll);
            return smooth[k];
        }

        private void moments(int at, int k, double gap) {
            double n = count[at][k] + 1.0;
            count[at][k] = n;
            if (n > 1.0) {
                double rate = 1 / n;
                rate = rate < RATE_LEAST ? RATE_LEAST : rate > RATE_MOST ? RATE_MOST : rate;
                mean[at][k] += rate * gap;
                var[at][k] = (1 - rate) * (var[at][k] + rate * gap * gap);
            } else mean[at][k] += gap;
        }

        private void layers(boolean learn, Object[] out, int to) {
            int n = nets.length;
            Object[] rmse = plan.wanted[2] ? new Object[n] : null, score = plan.wanted[3] ? new Object[n] : null, relative = plan.wanted[4] ? new Object[n] : null;
            double most = 0.0;
            for (int l = 0; l < n; l++) {
                int[] place = plan.places[l];
                boolean there = true;
                for (int k = 0; k < place.length && there; k++) {
                    there = place[k] >= 0 && x[place[k]] == x[place[k]];
                    if (there) inputs[l][k] = x[place[k]];
                }
                double found = 0.0;
                joint[l] = 1.0;
                if (there) {
                    Net net = nets[l];
                    net.frame(inputs[l], learn);
                    found = net.score;
                    joint[l] = net.relative > 5.0 ? 5.0 : net.relative;
                    if (rmse != null) rmse[l] = Double.valueOf(net.rmse);
                }
                most = found > most ? found : most;
                if (score != null) score[l] = Double.valueOf(found);
                if (relative != null) relative[l] = Double.valueOf(joint[l]);
            }
            output.frame(joint, learn);
            most = output.score > most ? output.score : most;
            out[to] = rmse;
            out[to + 1] = score;
            out[to + 2] = relative;
            out[to + 3] = Double.valueOf(most < 1.0 ? most : 1.0);
        }

        private void drift(double ts, Object[] out, int to) {
            frames++;
            for (int k = 0; k < size; k++) reference[k].push(recent[k].push(x[k]));
            if (frames % DRIFT_EVERY != 0) return;
            Object[] checks = new Object[size];
            boolean[] hit = new boolean[size];
            boolean some = false;
            for (int k = 0; k < size; k++) {
                if (ready(k) && ts - drifted[k] >= DRIFT_COOLDOWN) {
                    psi[k] = index(reference[k], recent[k]);
                    hit[k] = psi[k] >= DRIFT_PSI;
                    if (hit[k]) {
                        reference[k].take(recent[k]);
                        drifted[k] = ts;
                        some = true;
                    }
                }
                if (plan.wanted[7])
                    checks[k] = RowFactory.create(new Object[] {plan.names[k], Double.valueOf(psi[k]), Integer.valueOf(reference[k].count), Integer.valueOf(recent[k].count), Boolean.valueOf(ready(k)), Boolean.valueOf(hit[k])});
            }
            if (plan.wanted[6]) out[to] = Integer.valueOf(frames);
            if (plan.wanted[7]) out[to + 1] = checks;
            if (!plan.adapt || !some) return;
            boolean[] done = new boolean[nets.length];
            for (int k = 0; k < size; k++) {
                if (!hit[k]) continue;
                for (int at = 0; at <= HOURS; at++) {
                    count[at][k] = 0.0;
                    mean[at][k] = 0.0;
                    var[at][k] = 0.0;
                }
                smooth[k] = 0.0;
                high[k] = 0.0;
                low[k] = 0.0;
                frozen[k] = 0.0;
                int net = plan.netOf[k];
                if (net >= 0 && !done[net]) {
                    nets[net].restart();
                    done[net] = true;
                }
            }
        }

        private boolean ready(int k) {
            return reference[k].count >= DRIFT_MIN && recent[k].count >= DRIFT_MIN;
        }

        /** Population stability index over the reference's decile edges. */
        private static double index(Ring reference, Ring recent) {
            double[] a = Arrays.copyOf(reference.values, reference.count), b = Arrays.copyOf(recent.values, recent.count);
            Arrays.sort(a);
            Arrays.sort(b);
            double total = 0.0;
            int low = 0, lowB = 0;
            for (int e = 1; e <= 10; e++) {
                int high = a.length, highB = b.length;
                if (e < 10) {
                    double place = e * (a.length - 1) / 10.0;
                    int at = (int) Math.floor(place);
                    double part = place - at;
                    double edge = a[at] * (1 - part) + a[Math.min(at + 1, a.length - 1)] * part;
                    high = upto(a, edge);
                    highB = upto(b, edge);
                }
                double p = Math.max((double) (high - low) / a.length, 1e-4), q = Math.max((double) (highB - lowB) / b.length, 1e-4);
                total += (q - p) * Math.log(q / p);
                low = high;
                lowB = highB;
            }
            return total;
        }

        private static int upto(double[] values, double edge) {
            int low = 0, high = values.length;
            while (low < high) {
                int at = (low + high) >>> 1;
                if (values[at] <= edge) low = at + 1;
                else high = at;
            }
            return low;
        }
    }
}
"""
_DOUBLES = ["RATE_LEAST", "RATE_MOST", "SMOOTHING", "DEADBAND", "MAX_CONTRIBUTION", "FREEZE_AT", "FREEZE_COUNT", "FREEZE_STEPS", "CUSUM_K", "CUSUM_LIMIT", "BUCKET_WARM", "COLD_SPREAD", "SPREAD_FLOOR", "LEARNING", "SETTLE", "NET_WARM", "NET_FREEZE", "DRIFT_MIN", "DRIFT_PSI", "DRIFT_COOLDOWN"]
_INTS = ["HOURS", "REFERENCE_SIZE", "RECENT_SIZE", "DRIFT_EVERY"]

_sent: dict[str, object] = {}


def _climb_class(spark: SparkSession):
    """The compiled class on the driver; its jar goes to the executors once an application."""
    from hostvigil.operators import ladder

    application = spark.sparkContext.applicationId
    if application not in _sent:
        fixed = [f"static final double {n} = {float(getattr(ladder, n))!r};" for n in _DOUBLES] + [f"static final int {n} = {getattr(ladder, n)};" for n in _INTS]
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.replace("static final int WIDTH = 8;", "static final int WIDTH = 8;\n" + "\n".join(fixed)))
        path = Path(driver_path("classes"), "hostvigil-climb.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(str(path))
        _sent[application] = compiler.getClassLoader().loadClass(NAME)
    return _sent[application]


def _numbers(values) -> str:
    return " ".join(repr(float(v)) for v in values)


def climbed(frames: DataFrame, ladder, learn: str | None, limits: list[float] | None, kept: list[str], added: list[T.StructField], wanted: set[str], packed: list[str]) -> DataFrame:
    """`frames`, dealt and sorted, with the columns of ADDED that are `wanted` (null else), as an empty `ladder` gives them; the
    columns `packed` come as one array, as rows of many columns make code that the JVM doesn't compile."""
    import numpy as np

    from hostvigil.catalogue import LAYER_OF
    from hostvigil.operators.ladder import ORDER

    spark, place = frames.sparkSession, {n: i for i, n in enumerate(frames.columns)}
    lines = [
        [place["host_id"], place["ts"], -1 if learn is None else place[learn]],
        [place[n] for n in kept],
        [place[f] for f in ladder.features],
        ladder.baselines.sign,
        limits or [],
        [ORDER.index(LAYER_OF[f]) if LAYER_OF[f] in ORDER else -1 for f in ladder.features],
        [place[n] for n in packed],
        [*(s in ladder.stages for s in ("l1", "l2", "drift")), ladder.adapt, *(f.name in wanted for f in added)],
    ]
    text = [*map(_numbers, lines), " ".join(ladder.features)]
    for nets, places in ((ladder.nets, ladder.place), (ladder.output, [range(len(ORDER))])):
        for i, inputs in enumerate(places):
            n, h = int(nets.sizes[i]), int(nets.hidden[i])
            weights = lambda: np.concatenate((nets.into[i, :n, :h].ravel(), nets.back[i, :h, :n].ravel()))  # noqa: E731, B023
            first = weights()
            nets.restart(i)
            text += [_numbers(inputs), _numbers(first), _numbers(weights())]
    out = T.StructType([*[frames.schema[n] for n in kept], *added, *([T.StructField("packed", T.ArrayType(T.DoubleType()))] if packed else [])])
    given = spark.sparkContext._gateway.new_array(spark._jvm.Object, 1)
    given[0] = "\n".join(text)
    function = _climb_class(spark).getConstructors()[0].newInstance(given)
    encoder = spark._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(out.json()))
    return DataFrame(frames._jdf.mapPartitions(function, encoder), spark)
