"""Optional operators on text corpora: token ids, container filling, subject areas."""
