import pytest

from gridloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # small tables: plans are compiled more often than run
    return session
