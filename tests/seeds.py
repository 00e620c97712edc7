"""Two small project plans on working days, built by rule; the goldens in the tests are worked out by hand."""

import datetime as dt

D = dt.date.fromisoformat

# Plan 1: five tasks of two working days, one after another, from Monday 2027-03-01 (ends Friday 2027-03-12).
# Plan 2: four phases of 3, 5, 2 and 4 one-day steps from Monday 2027-04-05 (14 days, ends Thursday 2027-04-22).
PHASES = (3, 5, 2, 4)


def working_days(start: str, n: int) -> list:
    days, d = [], D(start)
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    return days


def seed_frames(spark):
    """Projects (ids 1, 2) and their tasks, with parent links resolved to task ids."""
    from workboard import schemas
    reg = dt.datetime(2027, 2, 1)
    a, b = working_days("2027-03-01", 10), working_days("2027-04-05", sum(PHASES))
    projects = [(1, "Biblioteca movil", None, "resp.a", a[0], a[-1], "Activo", reg),
                (2, "Huerto escolar", None, "resp.b", b[0], b[-1], "Activo", reg)]
    rows = [(i + 1, 1, f"Tarea {i + 1}", a[2 * i], a[2 * i + 1], 0, None, None, False, i + 1, None, None)
            for i in range(5)]
    at, order = 0, 1
    for n in PHASES:
        phase = len(rows) + 1
        rows.append((phase, 2, f"Fase {order}", b[at], b[at + n - 1], 0, None, None, False, order, None, None))
        order += 1
        for k in range(n):
            rows.append((phase + 1 + k, 2, f"Paso {order}", b[at + k], b[at + k], 0, None, None, False, order, None, phase))
            order += 1
        at += n
    return (spark.createDataFrame(projects, schemas.PROJECTS), spark.createDataFrame(rows, schemas.TASKS))
