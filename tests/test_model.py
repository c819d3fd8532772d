"""Random statements against a model in plain Python, through reopening."""

import random

import pytest

from sparkrel import ConstraintError, Database


@pytest.mark.parametrize("seed", [42, 7])
def test_random_statements(spark, tmp_path, seed):
    rng, path, model = random.Random(seed), str(tmp_path / "s"), {}
    show = lambda v: "" if v is None else str(v)
    db = Database(path, spark)
    db.execute("CREATE TABLE t (pk INT PRIMARY KEY, a INT NOT NULL, b TEXT NOT NULL, c INT)")
    for _ in range(60):
        pk, a, b, c = rng.randint(1, 30), rng.randint(1, 100), "".join(rng.choices("abc", k=rng.randint(1, 3))), rng.choice([None, rng.randint(1, 9)])
        do = rng.choice(["insert"] * 5 + ["update", "delete", "eq", "order", "group", "reopen", "rollback", "recreate", "commit"])
        if do == "insert":
            sql = f"INSERT INTO t VALUES ({pk}, {a}, '{b}', {'NULL' if c is None else c})"
            if pk in model:
                with pytest.raises(ConstraintError):
                    db.execute(sql)
            else:
                db.execute(sql)
                model[pk] = (a, b, c)
        elif do == "update":
            hit = [k for k, r in model.items() if r[0] < a]
            assert db.execute(f"UPDATE t SET b = '{b}', c = a + 1 WHERE a < {a}").rows_affected == len(hit)
            model |= {k: (model[k][0], b, model[k][0] + 1) for k in hit}
        elif do == "delete":
            hit = [k for k in model if k == pk]
            assert db.execute(f"DELETE FROM t WHERE pk = {pk}").rows_affected == len(hit)
            model = {k: r for k, r in model.items() if k != pk}
        elif do == "eq":
            assert db.execute(f"SELECT pk FROM t WHERE b = '{b}'").rows == [[str(k)] for k, r in model.items() if r[1] == b]
        elif do == "order":
            want = sorted(model.items(), key=lambda x: (x[1][2] is None, x[1][2] or 0))
            assert db.execute("SELECT pk, c FROM t ORDER BY c").rows == [[str(k), show(r[2])] for k, r in want]
        elif do == "group":
            sums: dict = {}
            for r in model.values():
                sums[r[1]] = sums.get(r[1], 0) + r[0]
            assert db.execute("SELECT b, SUM(a) FROM t GROUP BY b").rows == [[k, str(v)] for k, v in sums.items()]
        elif do == "reopen":
            db.close()
            db = Database(path, spark)
        elif do == "recreate":
            # The new table may begin with the very rows of the old one.
            keep = dict(list(model.items())[: rng.randint(0, len(model))]) | ({pk: (a, b, c)} if pk not in model else {})
            db.execute("BEGIN; DROP TABLE t; CREATE TABLE t (pk INT PRIMARY KEY, a INT NOT NULL, b TEXT NOT NULL, c INT)")
            for k, (x, y, z) in keep.items():
                db.execute(f"INSERT INTO t VALUES ({k}, {x}, '{y}', {'NULL' if z is None else z})")
            if rng.random() < 0.7:
                db.execute("COMMIT")
                model = keep
            db.close()
            db = Database(path, spark)
        elif do == "commit":
            db.execute(f"BEGIN; DELETE FROM t WHERE pk = {pk}; INSERT INTO t VALUES ({pk}, {a}, '{b}', NULL); COMMIT")
            model.pop(pk, None)
            model[pk] = (a, b, None)
            db.close()
            db = Database(path, spark)
        else:
            db.execute("BEGIN; DELETE FROM t WHERE a > 10; ROLLBACK")
    assert db.execute("SELECT COUNT(*), SUM(a) FROM t").rows == [[str(len(model)), show(sum(r[0] for r in model.values()) if model else None)]]
    db.close()
