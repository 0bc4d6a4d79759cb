"""Cases over literal rows: a function beside the SQL of its rows."""

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add
