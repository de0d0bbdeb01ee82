"""Relational operators: peaks, landmark pairing, voting, ranking."""
