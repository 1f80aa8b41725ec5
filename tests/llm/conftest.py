import pytest
from llm_samples import DOCS, edited, prose, rows


@pytest.fixture(scope="session")
def llm(spark):
    from rollcall.llm.shared import prepared

    return prepared(spark)


@pytest.fixture(scope="session")
def texts():
    base, other = prose(1, 120), prose(2, 90)
    return [base, None, "", " \t\n ", other, base, edited(base, 60), "one", "Ünïcode   und mehr\nZeilen\r\n\n" + prose(3, 40),
            "\n".join([prose(4, 12)] * 4), prose(5, 30) + " " + " ".join(base.split()[20:70]), prose(6, 6000),
            " ".join(["same"] * 300), "x" * 5000, "a<|endoftext|>b 123's  it's", other]


@pytest.fixture(scope="session")
def docs(llm, texts):
    made = rows(texts)
    made += [made[4], (None, prose(7, 50), None, None, None, None, None, None, None, None)]
    return llm.createDataFrame(made, DOCS)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)
