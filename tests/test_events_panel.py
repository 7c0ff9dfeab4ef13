from helpers import rows
from pyspark.sql import functions as F

from panelwright.operators import contracts
from panelwright.plans import events, firm_panel
from panelwright.sources import tables as S


def raw(spark):
    data = [
        ("E1", 1, "A00000001", "2025-01-01", "N", 10.0, 0),
        ("E1", 2, "A00000001", "2025-01-01", "N", 9.0, 0),
        ("E2", 1, "A00000002", "2025-01-01", "N", 5.0, 1),
        ("E3", 1, "bad-account", "2025-01-01", "N", 7.0, 0),
        ("E4", 1, "A00000004", "2025-01-02", "S", 1.0, 0),
        ("E4", 2, None, "2025-01-02", "S", 1.0, 0),
        ("E5", 1, "A00000001\n", "2025-01-02", "S", 2.0, 0),
    ]
    return spark.createDataFrame(data, "event_id string, ingest_seq int, account_id string, d string, region string, amount double, is_reversal int").withColumn(
        "date", F.to_date("d")
    )


def test_rollup_takes_the_last_ingest_before_the_filter(spark):
    clean = events.clean_events(raw(spark))
    got = [(str(r.date), r.region, r.n_events, r.n_accounts, r.gross_amount, r.net_amount) for r in events.daily_region_summary(clean).collect()]
    assert got == [("2025-01-01", "N", 2, 2, 14.0, 4.0)]
    assert rows(events.event_quality(raw(spark))) == [(7, 5, 2, 3, 2)]


class Files:
    """Golden shape of the firm panel task: 200 firms, 8 quarters, 120 adopters."""

    def __init__(self, spark):
        firms = [f"F{i:04d}" for i in range(1, 201)]
        forms = [lambda f: f.lower(), lambda f: f.replace("F", "F-"), lambda f: f" {f[1:]} ", lambda f: f"firm_{f[1:]}", lambda f: f]
        ends = ["03-31", "06-30", "09-30", "12-31"]
        quarters = [(y, q) for y in (2024, 2025) for q in (1, 2, 3, 4)]
        spell = [lambda y, q: f"{y}Q{q}", lambda y, q: f"{y}-Q{q}", lambda y, q: f"{y}-{ends[q - 1]}"]
        emp, fin = [], []
        for i, f in enumerate(firms):
            for j, (y, q) in enumerate(quarters):
                emp.append((forms[(i + j) % 5](f), spell[(i + j) % 3](y, q), str(30 + i + j), f"2026-01-0{j + 1}"))
                fin.append((forms[(i + j + 2) % 5](f), spell[(i + j + 1) % 3](y, q), f"${1000 * (i + 1) + j:,.2f}", f"2026-02-0{j + 1}"))
        emp += [(e[0], e[1], str(int(e[2]) + 3), "2026-03-20") for e in (emp[13], emp[144], emp[777], emp[1211])]
        fin += [(e[0], e[1], "$5.00", "2026-03-21") for e in (fin[31], fin[402], fin[999])]
        emp.append(("UNKNOWN-X", "2024Q1", "99", "2026-02-01"))
        fin.append(("", "2024Q2", "$100,000.00", "2026-02-01"))
        adopted = [(forms[i % 5](f), f"2024-{3 * (i % 4) + 1:02d}-15", "verified") for i, f in enumerate(firms[:120])]
        adopted += [adopted[10], ("bad-id", "2024-06-01", "verified"), (forms[0](firms[150]), "not-a-date", "verified")]
        codes = "NCSE"
        master = [(f, f"Company {i:03d}", codes[i % 4]) for i, f in enumerate(firms)] + [("F0008", "Company 007 Ltd", codes[7 % 4])]
        make = spark.createDataFrame
        self.firm_master = make(master, "firm_id string, legal_name string, region_code string")
        self.employment = make(emp, "firm_key string, quarter string, employees string, correction_ts string")
        self.financials = make(fin, "company_identifier string, period string, revenue string, correction_ts string")
        self.ai_adoption = make(adopted, "entity_id string, adoption_date string, status string")
        self.regions = make([("N", "North"), ("C", "Central "), ("S", "south"), ("E", "EAST")], "region_code string, region_name string")


def test_firm_panel_goldens(spark):
    job = firm_panel.FirmPanel(Files(spark), F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date"))
    panel = job.panel.cache()
    assert panel.columns == ["firm_id", "quarter", "region", "employees", "revenue_usd", "ai_adopted"]
    q = job.quality.first().asDict()
    assert (q["final_rows"], q["duplicate_keys"], q["unique_firms"], q["unique_quarters"]) == (1600, 0, 200, 8)
    assert panel.where("ai_adopted = 1").select("firm_id").distinct().count() == 120
    assert rows(contracts.check_monotone(panel, "firm_id", "quarter", "ai_adopted")) == [("monotone", True, 0)]
    assert panel.where("employees is null or revenue_usd is null or region is null").count() == 0
    reasons = dict(rows(job.exclusions))
    assert reasons == {
        "employment: no firm id": 1, "financials: no firm id": 1, "adoption: no firm id": 1, "adoption: bad date": 1,
        "employment: superseded": 4, "financials: superseded": 3, "master: duplicate firm": 1,
    }
    # 13 -> firm 2, quarter index 5: the correction wins.
    assert rows(panel.where("firm_id = 'F0002' and quarter = '2025Q2'"), "employees") == [(30 + 1 + 5 + 3,)]
    assert rows(panel.where("firm_id = 'F0008'"), "region")[0] == ("East",)


def test_summary_stats(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None), (8, 4.0)], "a int, b double")
    assert rows(firm_panel.summary_stats(df, ["a", "b"])) == [
        ("a", 3, 4.0, 3.6056, 1.0, 3.0, 8.0), ("b", 2, 3.0, 1.4142, 2.0, 3.0, 4.0)
    ]


def test_fingerprint_ignores_order_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    b = a.repartition(3).orderBy(F.col("i").desc())
    changed = a.withColumn("s", F.when(F.col("i") == 1, "z").otherwise(F.col("s")))
    assert rows(S.fingerprint(a, ["i", "s"])) == rows(S.fingerprint(b, ["i", "s"]))
    assert rows(S.fingerprint(a, ["i", "s"])) != rows(S.fingerprint(changed, ["i", "s"]))


def test_published_versions(spark, tmp_path):
    place = f"file://{tmp_path}/table"
    first = S.publish(spark.range(3), place)
    running, other = S.published(spark, place), spark.newSession()
    S.publish(spark.range(5), place)
    assert (S.published(other, place).count(), running.count()) == (5, 3)  # another session sees the new one, a reader keeps the old
    late = S.publish(spark.range(7), place, grace_seconds=0)
    assert S.published(other, place).count() == 7
    kept = sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("version-"))
    assert kept == [late] and first not in kept
    assert (tmp_path / "table" / "_current").read_text() == late


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"abc")
    got = S.file_hashes(spark, str(tmp_path)).first()
    assert (got.bytes, got.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
