"""A small made-up clinic with every source table of the study, for the end-to-end test."""

import datetime as dt

import numpy as np
import pandas as pd

from cohortloom.plans.study import Sources

SITES = ["NORTH", "SOUTH"]
BASE = dt.date(2012, 1, 1)

DRUGS = [
    ("1", "mesalamine 250 MG Oral Tablet", "SCD", "N"), ("2", "Pentasa 500 MG Oral Capsule", "SBD", "N"),
    ("3", "prednisone 5 MG Oral Tablet", "SCD", "N"), ("4", "infliximab", "IN", "N"),
    ("5", "azathioprine 50 MG Oral Tablet", "SCD", "N"), ("6", "mesalamine Rectal Enema", "SCD", "N"),
    ("7", "aspirin 81 MG", "SCD", "N"),
]
LABS = [
    ("L1", "Hemoglobin [Mass/volume] in Blood", "hemoglobin", "g/dL", 12, 2),
    ("L2", "Platelets [#/volume] platelet count", "platelet_count", "10*3/uL", 300, 60),
    ("L3", "Leukocytes [#/volume] in Blood", "leukocyte", "10*3/uL", 8, 2),
    ("L4", "Albumin [Mass/volume]", "albumin", "g/dL", 4, 0.5),
    ("L5", "Erythrocyte sedimentation rate", "ESR", "mm/h", 20, 8),
    ("L6", "C reactive protein", "CRP", "mg/L", 10, 5),
    ("L7", "Neutrophils fraction", "neutrophil", "%", 55, 10),
    ("L8", "Monocytes fraction", "monocyte", "%", 6, 2),
    ("L9", "Lymphocytes fraction", "lymphocyte", "%", 30, 8),
    ("L10", "Basophils fraction", "basophil", "%", 1, 0.3),
    ("L11", "Eosinophils fraction", "eosinophil", "%", 3, 1),
]


def build(spark, persons=240, seed=11):
    rng = np.random.default_rng(seed)
    people, dx, px, rx, disp, adm, vit, obs, lab, enc = ([] for _ in range(10))

    def on(days):
        return BASE + dt.timedelta(days=int(days))

    for i in range(persons):
        p, site = f"P{i:04d}", SITES[i % 2]
        first = int(rng.integers(0, 2000))
        age = rng.uniform(5, 16)
        people.append((p, site, on(first - age * 365), "M" if rng.random() < 0.5 else "F",
                       rng.choice(["05", "05", "03", "UN", "02"]), rng.choice(["Y", "N", "N", "NI"])))
        code = rng.choice(["556.9", "K51.90"])
        dx.append((p, site, code, on(first), on(first - 1) if i % 3 else None, rng.choice(["IP", "AV", "ED"])))
        if i % 12 == 0:
            dx.append((p, site, "K51.40", on(first + 50), None, "AV"))
        if i % 4 == 0:
            dx.append((p, site, "R10.9", on(first - 5), None, "AV"))
        last = first + int(rng.integers(400, 2500))
        dx.append((p, site, "Z00", on(last), on(last), "AV"))
        risk = rng.random()
        start = first + int(rng.integers(-5, 40))
        if rng.random() < 0.85:
            rx.append((p, site, rng.choice(["1", "2"]), on(start), on(start)))
        if rng.random() < 0.7:
            adm.append((p, site, "3", "RX", on(start + int(rng.integers(0, 20)))))
        if risk < 0.45:
            disp.append((p, site, "NDC5", on(start + int(rng.integers(30, 300)))))
        if risk < 0.25:
            adm.append((p, site, "NDC4", "ND", on(start + int(rng.integers(60, 600)))))
        if risk < 0.06:
            px.append((p, site, "44150", on(start + 700), on(start + 700)))
        px.append((p, site, "99999", on(first + 10), None))
        height = 30 + 3 * age + rng.normal()
        if rng.random() < 0.9:
            vit.append((p, site, height, 2.2 * age * 3 + 10 + rng.normal() * 4, None, on(first + 3)))
        else:
            obs.append((p, site, "LC", "8302-2", height, "in", on(first + 3)))
            obs.append((p, site, "LC", "29463-7", 30.0 + age, "kg", on(first + 3)))
        for code, _text, _name, unit, mean, sd in LABS:
            if rng.random() < 0.8:
                value = float(round(mean + sd * rng.normal() - 1.5 * sd * (risk < 0.3), 1))
                lab.append((p, site, code, on(first + 1), on(first + 1), on(first + 2), max(value, 0.1), None, unit, None))
        if i % 5 == 0:
            enc.append((p, site, "IP", on(first - 1), on(first + 2)))

    def frame(rows, names, kinds):
        return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names.split(), kinds.split())))

    def curve(m0, m1, s):
        rows = [(float(sex), a + 0.5, l, m0 + m1 * a, s) for sex in (1, 2) for a in range(24, 241, 1)
                for l in (-1.0 if a % 2 else 0.5,)]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["sex", "agemos", "l", "m", "s"]))

    s, d, f = "string", "date", "double"
    return Sources(
        demographic=frame(people, "patid site birth_date sex race hispanic", f"{s} {s} {d} {s} {s} {s}"),
        diagnosis=frame(dx, "patid site dx dx_date admit_date enc_type", f"{s} {s} {s} {d} {d} {s}"),
        procedures=frame(px, "patid site px px_date admit_date", f"{s} {s} {s} {d} {d}"),
        prescribing=frame(rx, "patid site rxnorm_cui rx_start_date rx_order_date", f"{s} {s} {s} {d} {d}"),
        dispensing=frame(disp, "patid site ndc dispense_date", f"{s} {s} {s} {d}"),
        med_admin=frame(adm, "patid site medadmin_code medadmin_type medadmin_start_date", f"{s} {s} {s} {s} {d}"),
        vital=frame(vit, "patid site ht wt original_bmi measure_date", f"{s} {s} {f} {f} {f} {d}"),
        obs_clin=frame(obs, "patid site obsclin_type obsclin_code obsclin_result_num obsclin_result_unit "
                            "obsclin_start_date", f"{s} {s} {s} {s} {f} {s} {d}"),
        lab_result=frame(lab, "patid site lab_loinc lab_order_date specimen_date result_date result_num result_qual "
                              "result_unit norm_modifier_high", f"{s} {s} {s} {d} {d} {d} {f} {s} {s} {s}"),
        encounter=frame(enc, "patid site enc_type admit_date discharge_date", f"{s} {s} {s} {d} {d}"),
        drug_dictionary=frame(DRUGS, "rxcui str tty suppress", f"{s} {s} {s} {s}"),
        drug_attributes=frame([("4", "NDC", "RXNORM", "NDC4", "N"), ("5", "NDC", "RXNORM", "NDC5", "N"),
                               ("5", "NDC", "OTHER", "NDC9", "N")], "rxcui atn sab atv suppress",
                              f"{s} {s} {s} {s} {s}"),
        lab_dictionary=frame([(c, t, t) for c, t, *_ in LABS], "loinc_num component long_common_name",
                             f"{s} {s} {s}"),
        curves={"BMI": curve(14, 0.03, 0.12), "HT": curve(80, 0.45, 0.04), "WT": curve(10, 0.25, 0.15)},
    )
