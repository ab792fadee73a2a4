from strandloom.check import main


def test_checkers(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(
        "> #Info (40,1,0.0) #Pat <CA>10<AG>10 #Annotation (AC)10(AG)10\n" + "AC" * 20 + "\n> #Info (20,1,0.0) #Pat <AC>10 #Annotation (AC)14\nACAC\nACAC\n> plain\nACGT\n"
    )
    main(["annotated", "-i", str(tmp_path / "a.fa"), "-a", "0.0"])
    assert capsys.readouterr().out.split() == ["1", "2", "24"]
    hit = "  {n} 1.0 0.0 0.0 {id} {a} {b} ({left}) + ({u})n Simple_repeat 1 2 (0) 1\n"
    rows = [("(AC)10(AG)5", 1, 20, 10, "AC"), ("(AC)10(AG)5", 21, 30, 0, "GA"), ("(AAG)9_2", 1, 12, 0, "AAG"), ("(A)30", 1, 30, 0, "A")]
    (tmp_path / "rm").write_text("SW perc\nscore div\n\n" + "".join(hit.format(n=k, id=i, a=a, b=b, left=left, u=u) for k, (i, a, b, left, u) in enumerate(rows)))
    main(["repeatmasker", "-i", str(tmp_path / "rm"), "-p"])
    lines = capsys.readouterr().out.splitlines()
    assert sorted(lines[:-1]) == ["No\tAAG 9\tAAG 4", "Yes\tAC 10 AG 5\tAC 10 GA 5"] and lines[-1] == "1 2"
    main(["parse", "-i", str(tmp_path / "rm"), "-o", str(tmp_path / "hits"), "-h"])
    told = [x for p in sorted((tmp_path / "hits").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(told) == 4 and "(AC)10(AG)5\t30\t1\t20\t20\tAC\tSimple_repeat" in told
    (tmp_path / "trf").write_text("@(AC)10\n1 20 2 10.4 2 95 0 100 50 50 0 0 1.0 CA CACA\n@(AG)9\n")
    main(["trf", "-i", str(tmp_path / "trf")])
    assert capsys.readouterr().out.split() == ["1", "2"]
