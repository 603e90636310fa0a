"""What a worker keeps from one kind of work to the next."""

import pytest

from vitalstrand.llm import near_dedup, toxicity
from vitalstrand.llm.encoding import encoder_of
from vitalstrand.llm.queries import tokenizer


@pytest.mark.parametrize("work", [near_dedup._sets, near_dedup._verified, toxicity._features])
def test_other_work_gives_up_the_encoder(work):
    encoder_of(tokenizer()[0])
    assert encoder_of.cache_info().currsize == 1
    list(work(iter([])))
    assert encoder_of.cache_info().currsize == 0
